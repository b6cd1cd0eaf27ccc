import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from tessera.llm import common, lines

PLAN = dict(min_docs=3, min_tokens=3, alike=0.75)


def brute(rows, least=3, alike=0.75):
    """The same tree in plain Python."""

    def masked(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))

    placed, docs_of, chosen = [], {}, {}
    for i, text in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            t = masked(line)
            if i is not None and len(t) >= 3:
                leaf = (len(t), *t[:3])
                placed.append((i, at, leaf, t))
                docs_of.setdefault(leaf, {}).setdefault(t, set()).add(i)
    for leaf, found in docs_of.items():
        if len(set().union(*found.values())) < least:
            continue
        often = Counter((k, t) for line, d in found.items() for k, t in enumerate(line) for _ in d)
        fits, docs = {}, {}
        for line, d in found.items():
            fixed = sorted((often[k, t], k) for k, t in enumerate(line) if k >= 3 and often[k, t] >= least)
            rare = {k for k in range(3, len(line))} - {k for _, k in fixed}
            more = len(line) - math.ceil(alike * len(line) - 1e-9) - len(rare)
            options = [(0, -1, set())] * (more >= 0) + [(1, k, {k}) for _, k in fixed] * (more >= 1)
            most = min(more, len(fixed))
            options += [(m, -1, {k for _, k in fixed[:m]}) for m in range(2, most + 1) if m.bit_count() == 1 or m == most]
            for cost, place, gone in options:
                template = tuple(None if k in rare | gone else t for k, t in enumerate(line))
                fits.setdefault(line, []).append((cost, place, template))
                docs[template] = docs.get(template, set()) | d
        for line, options in fits.items():
            good = [o[:2] + (o[2],) for o in options if len(docs[o[2]]) >= least]
            if good:
                chosen[leaf, line] = min(docs[min(good, key=lambda o: o[:2])[2]])
    gone = {}
    for i, at, leaf, line in placed:
        if i != chosen.get((leaf, line), i):
            gone.setdefault(i, set()).add(at)
    return {(i, text): ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())) if text is not None else None, len(text.split("\n")) if text is not None else 0, len(gone.get(i, ()))) for i, text in rows}


def rows():
    log = ["user {} logged in from host {} at noon", "disk {} is full on node {} again"]
    out = [(i, f"{chr(97 + i)} own text is here\n{log[i % 2].format(i, i * 7)}\n\nAll rights reserved.\n{log[i % 2].format(i + 50, 'x')}\nlast words") for i in range(8)]
    out += [(20, None), (21, ""), (22, "All rights reserved."), (None, "All rights reserved."), (23, "All  rights\treserved.\n a b"), (24, "the end of it all now\n" * 3), (25, "the end of it all then\nthe end of it some now"), (26, "the end of it all now")]
    return out


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)


def test_recurring_templates_are_dropped(spark, joins):
    df = spark.createDataFrame([Row(doc_id=i, text=t, leaf="x", at=1, n_lines=9) for i, t in rows()], "doc_id long, text string, leaf string, at int, n_lines int")
    got = lines.drop_recurring_lines(df, **PLAN).collect()
    texts = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got}
    assert texts == {(i, *v) for (i, _), v in brute(rows()).items()}
    by = {r.doc_id: r for r in got}
    assert by[0].text.startswith("a own text is here\nuser 0 logged")
    assert by[2].text == "c own text is here\n\nlast words"
    assert by[2].leaf == "x"
    assert by[22].text == ""
    assert by[20].text is None
    assert by[None].text == "All rights reserved."


def test_every_template_of_a_leaf_is_found(spark):
    kinds = ["red", "green", "blue", "white", "black", "brown", "pink"]
    texts = [(100 * k + i, f"the usual colour here is {c} for {name} and all\nown words {c} {name}") for k, c in enumerate(kinds) for i, name in enumerate(("ann", "bob", "cid", "dan", "eve", "fay"))]
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: v[2] for (i, _), v in brute(texts, 5, 0.8).items()}
    assert sum(got.values()) == 36  # each name's line is left once
    own = [(i, t.replace(" for ", f" for x{chr(97 + i % 100)}{chr(97 + i // 100)}").split("\n")[0]) for i, t in texts]
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 100 > 0) for i, _ in texts}  # each colour's template is left once


def test_random_lines_as_in_plain_python(spark):
    r = random.Random(5)
    make = lambda: " ".join(r.choice("a b c a1".split()) for _ in range(r.choice([2, 3, 4, 5, 8])))
    texts = [(i, "\n".join(make() for _ in range(r.choice([1, 4, 9])))) for i in range(120)] + [(500, "w " * 1_500 + "x"), (501, "w " * 1_500 + "y"), (502, "w " * 1_500 + "z")]
    got = {(x.doc_id, x.text): (x.text, x.n_lines, x.n_dropped) for x in lines.drop_recurring_lines(spark.createDataFrame(texts, "doc_id long, text string"), **PLAN).collect()}
    assert sorted((i, *v) for (i, _), v in got.items()) == sorted((i, *v) for (i, _), v in brute(texts).items())
    assert sum(v[2] for v in got.values()) > 100
    long = [(i, "w " * 50_000 + x) for i, x in enumerate("abcde")]
    got = lines.drop_recurring_lines(spark.createDataFrame(long, "doc_id long, text string")).select("doc_id", "n_dropped").collect()
    assert sorted(map(tuple, got)) == [(i, int(i > 0)) for i in range(5)]


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(i, "all of this is the same", 1, 2, 3, i) for i in range(4)], "doc_id long, text string, of int, hash int, Drop int, `a.b` long")
    got = lines.drop_recurring_lines(df, **PLAN).orderBy("doc_id").collect()
    assert [(r.of, r["hash"], r["Drop"], r["a.b"], r.n_dropped) for r in got] == [(1, 2, 3, i, int(i > 0)) for i in range(4)]


def test_repeated_rows_are_one_document_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in lines.drop_recurring_lines(df, **PLAN).collect())
    assert lines.drop_recurring_lines(df.limit(0), **PLAN).count() == 0


def test_main_path_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    plan = lines.drop_recurring_lines(df, **PLAN)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
