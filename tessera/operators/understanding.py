"""Query understanding: filters, tags, synonyms, variants, class and strategy, history.

Queries are rows, so rules are expressions over a text column; what adds synonyms or builds lists of variants in order
is a vectorised UDF. A null or empty query stays as it is, has no filter and the class ``general``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metadata import JAVA, copper_oz, layer_count
from tessera.functions.text import strip
from tessera.functions.vocabulary import CLASSES, GENERAL, REFERRING, SYNONYMS, protected_terms

Generate = Callable[[str], str]

# Explicit filters; phrases without content; what counts as a keyword or a name in a query.
EXPLICIT = r"\b(vendor|eda|layers|layer|oz|source_type|effective_date)\s*[:=]\s*([^\s;，,]+)"
POLITE, POLITE_LONG = "请问|请|帮我|我想|想要|想知道|如何|怎么|怎样", "请问|请|帮我|我想|想要|想知道|如何|怎么|怎样|在|中|的|时"
KEYWORDS = re.compile(r"[一-鿿]{2,}|[A-Za-z0-9]+")
NAMES = re.compile(r"""[【】《》""'']+([^【】《》""'']+)[【】《》""'']+|([A-Z][A-Za-z0-9_\-]+)""")
BULLET = re.compile(r"^[\d.\-*•·\s]+")
UNITS = r"\b\d+(?:\.\d+)?\s*(mm|mil|oz|ohm|μm|um|Ω|层)\b"


def filters(query: Column) -> Column:
    """``vendor, eda, layer_count, copper_oz, source_type, effective_date`` asked for; what is explicit wins."""
    keys = F.transform(F.regexp_extract_all(query, F.lit("(?i)" + JAVA + EXPLICIT), F.lit(1)), F.lower)
    values = F.regexp_extract_all(query, F.lit("(?i)" + JAVA + EXPLICIT), F.lit(2))
    said = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = lambda *names: F.try_element_at(F.filter(said, lambda x: x["k"].isin(*names)), F.lit(-1))["v"]
    low = F.lower(query)
    number = lambda v, drop, kind: F.when(v.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(v, drop, ""), F.lit("")), F.lit("0")).try_cast(kind))
    maker = F.when(low.contains("jlcpcb") | query.contains("嘉立创"), "JLCPCB").when(low.contains("pcbway"), "PCBWay")
    tool = F.when(low.contains("kicad"), "kicad").when(low.contains("altium") | low.rlike(JAVA + r"\bad\b"), "altium").when(low.contains("allegro"), "allegro")
    return F.struct(
        F.coalesce(last("vendor"), maker).alias("vendor"), F.coalesce(last("eda"), tool).alias("eda"),
        F.coalesce(number(last("layer", "layers"), r"[^0-9]+", "int"), layer_count(query)).alias("layer_count"),
        F.coalesce(number(last("oz"), r"[^0-9.]+", "double"), copper_oz(query)).alias("copper_oz"),
        last("source_type").alias("source_type"), last("effective_date").alias("effective_date"),
    )


def without_filters(query: Column) -> Column:
    """The query less its explicit filters; all of it if nothing else is there."""
    left = strip(F.regexp_replace(F.regexp_replace(query, "(?i)" + JAVA + EXPLICIT, " "), r"(?U)\s+", " "))
    asked = lambda f: reduce(lambda a, b: a | b, (f[k].isNotNull() for k in ("vendor", "eda", "layer_count", "copper_oz", "source_type", "effective_date")))
    any_filter = F.transform(F.array(filters(query)), asked)[0]  # bound once
    return F.when(any_filter & (left != ""), left).otherwise(query)


def with_tags(query: Column) -> Column:
    """The query, then the names of its tags, with white space evened out."""
    tags = F.array_distinct(F.regexp_extract_all(query, F.lit(r"<([a-zA-Z_][a-zA-Z0-9_:.-]*)>"), F.lit(1)))
    return strip(F.regexp_replace(F.when(F.size(tags) > 0, F.concat(query, F.lit(" "), F.array_join(tags, " "))).otherwise(query), r"(?U)\s+", " "))


def tagged(query: str) -> str:
    """``with_tags`` for one query."""
    tags = list(dict.fromkeys(re.findall(r"<([a-zA-Z_][a-zA-Z0-9_:.-]*)>", query)))
    return " ".join(" ".join([query, *tags]).split())


def expanded(query: str, most: int = 6) -> str:
    """The query and its synonyms: of the terms that come first in it first; none that is there already, each once."""
    low, found = query.lower(), {}
    for term, others in SYNONYMS.items():
        at = low.find(term.lower())
        for i, other in enumerate(others if at >= 0 else ()):
            if other.lower() not in low:
                found.setdefault(other.lower(), (at * 100 + i, other))
    n = min(most, 3) if len(query) > 30 else min(most + 2, 7) if len(query) < 10 else most
    return " ".join([query, *(s for _, s in sorted(found.values(), key=lambda x: x[0])[:n])])


def with_synonyms(query: Column, most: int = 6) -> Column:
    """``expanded`` for a column of queries."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([expanded(q, most) if q else q for q in s], dtype=object)

    return run(query)


def _add(out: list[str], variant: str, most: int) -> None:
    if len(out) < most and variant and variant.lower() not in (v.lower() for v in out):
        out.append(variant)


def _replaced(query: str) -> Iterator[str]:
    low = query.lower()
    for term, others in SYNONYMS.items():
        for other in others[:2]:
            if term in query:
                yield query.replace(term, other)
            elif term.lower() in low:
                yield low.replace(term.lower(), other.lower())


def rule_variants(query: str, most: int) -> list[str]:
    """The query, it with terms replaced, without polite phrases, and its keywords."""
    out = [query]
    for v in _replaced(query):
        _add(out, v, most)
    _add(out, re.sub(POLITE, "", query).strip(), most)
    words = KEYWORDS.findall(query)
    if len(words) >= 2:
        _add(out, " ".join(words[:5]), most)
    return out[:most]


def all_variants(query: str, tagged: str, expanded: str, most: int) -> list[str]:
    """As ``rule_variants``, after the tagged and the expanded query, and with the names in it last."""
    out = [query]
    for v in (tagged, expanded):
        if v not in out:
            out.append(v)
    for v in _replaced(query):
        _add(out, v, most)
    plain = re.sub(POLITE_LONG, "", query).strip()
    if len(plain) >= 4 and plain not in out and len(out) < most:
        out.append(plain)
    words = KEYWORDS.findall(query)
    if len(words) >= 2 and len(out) < most and " ".join(words[:5]) not in out:
        out.append(" ".join(words[:5]))
    names = " ".join(a or b for a, b in NAMES.findall(query))
    if len(names) >= 3 and len(out) < most and names not in out:
        out.append(names)
    return out[:most]


def variants(query: Column, most: int = 7) -> Column:
    """Variants of a query as an array, itself first."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([all_variants(q, tagged(q), expanded(q), most) if q else [q] for q in s], dtype=object)

    return run(query)


def rewritten(query: str, generate: Generate | None, n: int = 4) -> list[str]:
    """The query and ``n`` others that a generator writes, a line each; rules fill up what it lacks."""
    out = [query]
    if generate is not None:
        try:
            answer = generate(f"Write {n} other queries with the meaning of this one, a line each, without numbers.\n\n{query}\n")
        except Exception:  # a generator that fails leaves the rules
            answer = ""
        for line in answer.strip().split("\n"):
            _add(out, BULLET.sub("", line.strip()).strip(), n + 1)
    for v in rule_variants(query, n + 1):
        _add(out, v, n + 1)
    return out


def class_scores(query: Column) -> list[tuple[str, Column]]:
    """For each class: 10 for an expression, 3 for each keyword (4 as a word of its own), 2 for each pattern (3 at the start)."""
    q = strip(query)
    low = F.lower(q)
    out = []
    for name, c in CLASSES.items():
        parts = [F.when(reduce(lambda a, b: a | b, (q.rlike("(?i)" + JAVA + r) for r in c["regex"])), 10.0).otherwise(0.0)] if c.get("regex") else []
        parts += [F.when(low.contains(k.lower()), 3.0 + F.when(q.rlike(rf"(?i){JAVA}\b{re.escape(k)}\b"), 1.0).otherwise(0.0)).otherwise(0.0) for k in c["keywords"]]
        parts += [F.when(low.contains(p.lower()), 2.0 + F.when(low.startswith(p.lower()), 1.0).otherwise(0.0)).otherwise(0.0) for p in c["patterns"]]
        out.append((name, reduce(lambda a, b: a + b, parts)))
    return out


def classify(query: Column, protected=None) -> Column:
    """The class of the highest score (the first of several), at least 2; else by units, length and terms."""
    q = strip(query)
    scores = class_scores(query)
    names = F.array(*(F.lit(name) for name, _ in scores))
    # bound once, so that the scores are not worked out again for each use
    named = F.transform(F.array(F.array(*(x for _, x in scores))), lambda x: F.when(F.array_max(x) >= 2, F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))))[0]
    words = protected_terms() if protected is None else protected
    commas = F.length(q) - F.length(F.replace(q, F.lit("，"), F.lit("")))
    has_term = F.exists(F.array(*(F.lit(w) for w in sorted(words))), lambda w: F.lower(q).contains(w)) if words else F.lit(False)
    return (
        F.when(F.coalesce(q, F.lit("")) == "", "general").otherwise(F.coalesce(named, F.when(q.rlike("(?i)" + JAVA + UNITS), "specification")
        .when((F.length(q) > 35) | (commas > 2), "definition").when((F.length(q) < 15) & has_term, "specification").otherwise("general")))
    )


def strategy(query_class: Column) -> Column:
    """``vector_weight, bm25_weight, num_queries`` of a class."""
    as_struct = lambda c: F.struct(F.lit(c["weights"][0]).alias("vector_weight"), F.lit(c["weights"][1]).alias("bm25_weight"), F.lit(c["queries"]).alias("num_queries"))
    return reduce(lambda c, x: (F if c is None else c).when(query_class == x[0], as_struct(x[1])), CLASSES.items(), None).otherwise(as_struct(GENERAL))


def is_short(query: Column, most: int = 120) -> Column:
    return (F.length(query) <= most) | (F.size(F.regexp_extract_all(query, F.lit(r"[一-鿿]{2,}|[A-Za-z0-9]+"), F.lit(0))) < 4)


def hypothetical(query: Column, answer: Column, most: int = 300) -> Column:
    """The query with a generated passage below it; the query alone without one."""
    body = strip(F.regexp_replace(answer, r"(?s)<think>.*?</think>\s*", ""))
    body = strip(F.regexp_replace(F.regexp_replace(body, r"^\s*(输出|回答)\s*[:：]\s*", ""), r"^\s*(文档摘要|关键事实)\s*[:：]\s*", ""))
    marked = F.concat(F.lit("关键事实："), body)
    cut = F.when(F.length(marked) > most, F.concat(F.substring(marked, 1, most), F.lit("..."))).otherwise(marked)
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(query, F.lit("\n\n"), cut)).otherwise(query)


def hypothetical_by_rule(query: Column, answer: Column, most: int = 200, least: int = 20) -> Column:
    """The second route's passage: at least ``least`` characters, as it was written."""
    body = strip(F.regexp_replace(answer, r"(?s)<think>.*?</think>\s*", ""))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body)
    return F.when(F.length(body) >= least, F.concat(query, F.lit("\n\n"), cut)).otherwise(query)


def with_points(query: Column, answer: Column, most: int = 5) -> Column:
    """The query followed by the points of a generated list."""
    lines = F.slice(F.filter(F.transform(F.split(answer, "\n"), strip), lambda x: x != ""), 1, most)
    points = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[\d.\-*•·\s]+", ""))), lambda x: x != "")
    return F.when(F.size(points) > 0, F.concat(query, F.lit(" "), F.array_join(points, " "))).otherwise(query)


def generated(prompt: Column, load: Callable[[], Generate]) -> Column:
    """What a generator, made once per worker, answers; null where it fails."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = load()

        def one(p):
            try:
                return generate(p)
            except Exception:  # one query's failure leaves the others
                return None

        for s in batches:
            yield pd.Series([None if p is None else one(p) for p in s], dtype=object)

    return run(prompt)


def needs_history(query: Column, n_messages: Column) -> Column:
    """Whether a query has to be read with what was said before: there is something, and it is short or refers back."""
    refers = reduce(lambda a, b: a | b, (query.contains(w) for w in REFERRING))
    return (n_messages > 0) & ((F.length(query) <= 40) | refers)


def history(messages: DataFrame, last: int = 5, most: int = 200, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """``messages`` with ``history``: the ``last`` messages before each one as lines; long answers are cut."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(-last, -1)
    said = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("用户："), F.coalesce("text", F.lit("")))).when(F.col("role") == "assistant", F.concat(F.lit("助手："), F.coalesce(said, F.lit(""))))
    return messages.withColumn("_l", line).withColumn("history", F.array_join(F.collect_list("_l").over(before), "\n")).drop("_l")  # ``last`` rows


def accept_rewrite(query: Column, answer: Column) -> Column:
    """The rewritten query if it has between 4 and 499 characters."""
    body = strip(answer)
    return F.when((F.length(body) > 3) & (F.length(body) < 500), body).otherwise(query)
