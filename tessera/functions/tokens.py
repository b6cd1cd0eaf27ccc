"""Index terms of a text, as column expressions.

Terms are ASCII runs (lower-cased, stop words out unless protected), their neighbouring pairs, and for Chinese runs
the run, its pairs of characters and its single characters, unless a segmenter takes their place.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, Chinese and English.
STOP_WORDS = tuple("的 了 和 与 或 在 是 为 以 及 等 之 将 被 由 对 其 该 这 那 有 无 中 上 下 内 外 可 不 应 需 到 从 于 并 而 但 若 如 则 使 让 把 给 因 故 所 者".split()) + tuple(
    "the a an and or of to in on at for by with is are was were be been being have has had do does did will would could should may might must can this that these those it its".split()
)
ASCII, CHINESE = r"[A-Za-z0-9_+\-./]+", "[一-鿿]+"


def _isin(x: Column, words: Collection[str]) -> Column:
    return x.isin(*words) if words else F.lit(False)


def pairs(items: Column, gap: str) -> Column:
    """Neighbouring items joined by ``gap``."""
    n = F.size(items)
    joined = F.zip_with(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(gap), b))
    return F.when(n > 1, joined).otherwise(F.array().cast("array<string>"))


def terms(text: Column, stop: Collection[str] = STOP_WORDS, protected: Collection[str] = (), segment: Callable[[str], list[str]] | None = None, bigrams: bool = True) -> Column:
    """All terms of a text, with repeats. Pairs are made of the ASCII terms that are left, in order."""
    # joined, lowered and split again: one step a text instead of one a term
    lowered = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(ASCII), F.lit(0)), " ")), " ")
    keep = lambda w: (w != "") & (~_isin(w, [x for x in stop if x.isascii()]) | _isin(w, [x for x in protected if x in set(stop)]))
    plain = F.filter(lowered, keep)
    chinese = F.filter(F.regexp_extract_all(text, F.lit(CHINESE), F.lit(0)), lambda r: ~((F.length(r) == 1) & _isin(r, stop)))
    if segment is not None:
        parts = segmented(chinese, segment, tuple(stop))
    else:

        def split(run: Column) -> Column:
            one = F.array(F.filter(F.split(run, ""), lambda c: c != ""))
            return F.concat(F.array(run), F.transform(one, lambda c: F.concat(pairs(c, ""), F.filter(c, lambda x: ~_isin(x, stop))))[0])

        parts = F.flatten(F.transform(chinese, split))
    if not bigrams:
        return F.concat(plain, parts)
    # bound once, or else each use would make the list again
    return F.concat(F.transform(F.array(plain), lambda p: F.concat(p, pairs(p, "_")))[0], parts)


def segmented(runs: Column, segment: Callable[[str], list[str]], stop: tuple[str, ...]) -> Column:
    """Distinct words of each run by a segmenter, then the run itself."""
    skip = set(stop)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for found in s:
                words: list[str] = []
                for run in found if found is not None else ():
                    own = list(dict.fromkeys(w for w in map(str.strip, segment(run)) if w and w not in skip))
                    words += (own or [run]) + [run] * (len(run) > 1)
                out.append(words)
            yield pd.Series(out, dtype=object)

    return cut(runs)
