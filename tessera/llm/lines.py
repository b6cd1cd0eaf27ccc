"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed at a fixed depth: to a leaf by their number of tokens and their first ``LEAD`` tokens, where tokens
with a digit count as a variable field. In a leaf, a token that stands at its place in fewer than ``min_docs`` lines
of documents is a variable field too. As long as at least ``alike`` of a line's tokens stay fixed, it fits several
templates: that with no further variable field; those with any one of its tokens as a variable field; and those with
its two, four, eight and so on tokens, and as many as may be, that are rarest at their places (the first of several).
A template that lines of at least ``min_docs`` documents fit is recurring. A line takes the recurring template of the fewest further fields (the
first by place of several) and is dropped from all documents but the first, by id, with a line that fits it. So the
template stays in one document at least. All templates of all leaves are found in one pass, whatever their number; no
step gathers a leaf or a template.

Cases: null texts stay null; lines of fewer than ``min_tokens`` tokens, so also empty ones, are always kept; a line
repeated within one document counts once; copies count as documents; rows with a null id stay as they are and count
for nothing; ties are settled as said; lines of any length are parsed whole; rows of equal id and text are one document; the table may be empty; further columns are kept, whatever
their names, but for ``n_lines`` and ``n_dropped``, which are replaced. Tokens at their places and distinct lines are
told apart within a leaf by 64-bit hashes, templates by two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, settle, small, unused, written

LEAD = 3


def spaced(line: Column) -> Column:
    """The line's tokens, one space apart."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in "\t\r\v\f":
        odd = odd | line.contains(space)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """Variable fields for the tokens that hold a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """``doc_id, h, at, line, n, leaf`` of the lines that can be dropped; ``h`` tells texts of one id apart."""
    # per text first: what follows the explode would be done again for each of its lines, with the text beside it
    texts = docs.where("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), F.transform(F.transform(F.split("text", "\n", -1), spaced), masked).alias("lines"))
    # outer: else a filter on the array is put below, and all lines are made twice
    rows = texts.select("doc_id", "h", F.posexplode_outer("lines").alias("at", "line")).where("line IS NOT NULL")
    rows = rows.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_tokens)
    return rows.select("doc_id", "h", "at", "line", "n", F.xxhash64("n", F.substring_index("line", " ", LEAD)).alias("leaf"))


def fitting(found: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """``leaf, key, cost, place, t, u`` for each template that a distinct line (``leaf, key, line, n, docs``) fits:
    ``t, u`` name it within the leaf, ``cost`` is the number of further fields, ``place`` where a single one is."""
    places = F.slice(F.split("line", " "), LEAD + 1, F.greatest(F.col("n") - LEAD, F.lit(0)))
    tokens = found.select("leaf", "key", "docs", F.posexplode(places).alias("place", "token")).select("leaf", "key", "docs", "place", F.xxhash64("place", "token").alias("t"))
    fixed = keep(tokens.groupBy("leaf", "t").agg(F.sum("docs").alias("often")).where(F.col("often") >= min_docs), "fixed-tokens")
    held = tokens.select("leaf", "key", "place", "t").join(small(fixed, 24), ["leaf", "t"])
    held = held.groupBy("leaf", "key").agg(F.array_sort(F.collect_list(F.struct("often", "place", "t"))).alias("held"))  # tokens of one line
    n = F.col("n")
    whole = found.select("leaf", "key", "n").join(held, ["leaf", "key"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<often:bigint,place:int,t:bigint>>")))
    # further fields that a line may have: those of all, less its rare tokens; the leading tokens are the leaf's
    whole = whole.withColumn("more", (n - F.ceil(F.lit(alike) * n - 1e-9) - F.greatest(n - LEAD, F.lit(0)) + F.size("held")).cast("int")).where("more >= 0")
    twin = lambda t: F.xxhash64(t, F.lit(1))
    xor = lambda of, name: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(name(x["t"])))
    whole = whole.withColumns({"t": xor(F.col("held"), lambda t: t), "u": xor(F.col("held"), twin)})
    option = lambda cost, place, t, u: F.struct(cost.cast("int").alias("cost"), place.cast("int").alias("place"), t.alias("t"), u.alias("u"))
    none, t, u = F.lit(-1), F.col("t"), F.col("u")
    single = F.when(F.col("more") >= 1, F.transform("held", lambda x: option(F.lit(1), x["place"], t.bitwiseXOR(x["t"]), u.bitwiseXOR(twin(x["t"])))))
    rarest, most = lambda k: F.slice("held", F.lit(1), k), F.least("more", F.size("held"))
    counts = F.array_distinct(F.array_append(F.filter(F.array(*(F.lit(1 << i) for i in range(1, 31))), lambda k: k <= most), most))
    several = F.when(most >= 2, F.transform(counts, lambda k: option(k, none, t.bitwiseXOR(xor(rarest(k), lambda t: t)), u.bitwiseXOR(xor(rarest(k), twin)))))
    empty = F.array().cast("array<struct<cost:int,place:int,t:bigint,u:bigint>>")
    options = F.concat(F.array(option(F.lit(0), none, t, u)), F.coalesce(single, empty), F.coalesce(several, empty))
    return whole.select("leaf", "key", F.explode(options).alias("o")).select("leaf", "key", "o.*")


def recurring_lines(docs: DataFrame, min_docs: int, min_tokens: int, alike: float) -> DataFrame:
    """``doc_id, h, drop``: the places of the lines to drop from each document that has some."""
    since = written(docs.sparkSession)
    lines = _lines(docs, min_tokens)
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    leaves = small(keep(leaves, "leaves"), 8)
    seen = keep(lines.join(leaves, "leaf", "left_semi").withColumn("key", F.xxhash64("line")), "lines")
    found = seen.select("leaf", "key", "line", "n", "doc_id").distinct().groupBy("leaf", "key").agg(F.first("line").alias("line"), F.first("n").alias("n"), F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    found = keep(found, "distinct-lines")
    fits = fitting(found, min_docs, alike).join(found.select("leaf", "key", "docs", "first"), ["leaf", "key"])
    fits = keep(fits, "fitting")
    template = ["leaf", "t", "u"]
    # lines of documents are no fewer than documents, and as many where one line alone has enough of them
    often = fits.groupBy(*template).agg(F.sum("docs").alias("all"), F.max("docs").alias("most"), F.min("first").alias("first")).where(F.col("all") >= min_docs)
    often = keep(often.select(*template, "first", (F.col("most") >= min_docs).alias("sure")), "often")
    near = keep(fits.drop("first").join(small(often, 40), template), "near")
    rare = near.where("not sure").select(*template, "key")  # of lines in fewer than min_docs documents
    ids = rare.join(seen.select("leaf", "key", "doc_id"), ["leaf", "key"]).select(*template, "doc_id").distinct()
    proved = keep(ids.groupBy(*template).count().where(F.col("count") >= min_docs).select(*template), "proved")
    taken = near.where("sure").unionByName(near.where("not sure").join(small(proved, 24), template, "left_semi"))
    taken = taken.groupBy("leaf", "key").agg(F.min(F.struct("cost", "place", "first")).alias("o")).select("leaf", "key", "o.first")
    # stored, so that the join is by broadcast or has plain shuffles below it, and a frequent line can be split
    taken = small(keep(taken, "taken"), 24)
    dropped = seen.select("leaf", "key", "doc_id", "h", "at").join(taken, ["leaf", "key"]).where("doc_id <> first")
    return settle(dropped.groupBy("doc_id", "h").agg(F.collect_set("at").alias("drop")), "dropped-lines", since)  # places within one document


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, alike: float = 0.8) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from ``text``, and ``n_lines, n_dropped`` added."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.drop("n_lines", "n_dropped")
    d, h, drop = unused(docs, "of", "hash", "drop")
    drops = recurring_lines(own, min_docs, min_tokens, alike).toDF(d, h, drop)
    out = docs.join(drops, (F.col("doc_id") == F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(stay), lambda i: F.get(lines, i)), "\n"))
    ordered = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    plain = F.col("text").cast("string")
    n_lines = F.when(plain.isNull(), 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long")
    return out.select(*ordered, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def oracle(min_docs: int = 5, min_tokens: int = 3, alike: float = 0.8) -> str:
    """The same in DuckDB SQL over ``documents``, for rows of distinct ids."""
    return f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  places AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw WHERE doc_id IS NOT NULL),
  plain AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM places),
  lines AS (SELECT *, concat(len(string_split(line, ' ')), ' ', array_to_string(string_split(line, ' ')[1:{LEAD}], ' ')) AS leaf FROM plain WHERE len(string_split(line, ' ')) >= {min_tokens}),
  leaves AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc_id) >= {min_docs}),
  seen AS (SELECT * FROM lines WHERE leaf IN (SELECT leaf FROM leaves)),
  found AS (SELECT leaf, line, len(string_split(line, ' ')) AS n, count(DISTINCT doc_id) AS docs FROM seen GROUP BY leaf, line),
  tokens AS (SELECT leaf, line, docs, unnest(string_split(line, ' ')) AS token, unnest(range(n)) AS k FROM found),
  fixed AS (SELECT leaf, k, token, sum(docs) AS often FROM tokens WHERE k >= {LEAD} GROUP BY leaf, k, token HAVING sum(docs) >= {min_docs}),
  held AS (SELECT leaf, line, k, hash(k, token) AS h, row_number() OVER (PARTITION BY leaf, line ORDER BY often, k) AS r FROM tokens JOIN fixed USING (leaf, k, token)),
  of_line AS (SELECT leaf, line, count(*) AS fixed, bit_xor(h) AS x FROM held GROUP BY leaf, line),
  whole AS (SELECT f.leaf, f.line, coalesce(x, 0) AS x, n - CAST(ceil({alike} * n - 1e-9) AS BIGINT) - greatest(n - {LEAD}, 0) + coalesce(fixed, 0) AS more, fixed
    FROM found f LEFT JOIN of_line h ON f.leaf = h.leaf AND f.line = h.line),
  fits AS (
    SELECT leaf, line, 0 AS cost, -1 AS place, x AS template FROM whole WHERE more >= 0
    UNION ALL SELECT leaf, line, 1, k, xor(x, h) FROM held JOIN whole USING (leaf, line) WHERE more >= 1
    UNION ALL SELECT leaf, line, r, -1, xor(x, upto) FROM (SELECT *, bit_xor(h) OVER (PARTITION BY leaf, line ORDER BY r) AS upto FROM held) JOIN whole USING (leaf, line) WHERE r BETWEEN 2 AND more AND (bit_count(r) = 1 OR r = least(more, fixed))),
  recurring AS (SELECT leaf, template, min(doc_id) AS first FROM fits JOIN seen USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= {min_docs}),
  taken AS (SELECT leaf, line, arg_min(first, (cost, place)) AS first FROM fits JOIN recurring USING (leaf, template) GROUP BY leaf, line),
  dropped AS (SELECT p.doc_id, list(p.pos) AS gone FROM seen p JOIN taken USING (leaf, line) WHERE p.doc_id <> first GROUP BY p.doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN dropped USING (doc_id)"""
