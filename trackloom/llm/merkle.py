"""Document fingerprints as Merkle trees, with DataFrame functions only.

A text is cut into sections (at blank lines), paragraphs (at line ends) and clauses (after
punctuation); nothing is lost in the cuts. A clause's hash covers its characters, a paragraph's its
clauses, a section's its paragraphs, and the root the sections. Equal roots mean equal texts;
where roots differ, differing branches locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import text_of

#: Fixed value: a clause and its closing punctuation.
CLAUSE = r"[^.,;:!?|]+[.,;:!?|]*|[.,;:!?|]+"
#: Hexadecimal digits kept of a clause's and of a branch's SHA-256.
LEAF, BRANCH = 8, 16
_LOWEST = -(2**63)


def _cut(hash_of: Column, digits: int) -> Column:
    return F.left(F.sha2(hash_of, 256), F.lit(digits))


def tree(text: Column) -> Column:
    """Array of sections (hash, paragraphs), paragraphs being arrays of (hash, leaves). A paragraph
    without characters has no leaves."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda x: F.sha2(x, 256))
        return F.struct(_cut(F.concat_ws("", leaves), BRANCH).alias("hash"), F.transform(leaves, lambda x: F.left(x, F.lit(LEAF))).alias("leaves"))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    def with_hash(ps: Column) -> Column:
        return F.struct(_cut(F.concat_ws("", F.transform(ps, lambda p: p["hash"])), BRANCH).alias("hash"), ps.alias("paragraphs"))

    return F.transform(F.transform(F.split(text, "\n\n", -1), section), with_hash)


def fingerprint(tree_: Column) -> Column:
    """The tree as text: root#section(paragraph[leaf.leaf ...]...)..."""
    root = F.sha2(F.concat_ws("", F.transform(tree_, lambda s: s["hash"])), 256)
    paragraphs = lambda s: F.concat_ws("", F.transform(s["paragraphs"], lambda p: F.concat(p["hash"], F.lit("["), F.concat_ws(".", p["leaves"]), F.lit("]"))))
    return F.concat(root, F.lit("#"), F.concat_ws("", F.transform(tree_, lambda s: F.concat(s["hash"], F.lit("("), paragraphs(s), F.lit(")")))))


def leaves(tree_: Column) -> Column:
    """The distinct leaves; an empty text has the one leaf ''."""
    all_ = F.array_distinct(F.flatten(F.transform(tree_, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Of two distinct leaf lists: twice the shared over the sum, 0 to 1."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing(a: Column, b: Column) -> Column:
    """Places (section, paragraph), from 0, of ``a``'s paragraphs that ``b`` does not have there;
    sections with equal hashes are not entered."""
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def inside(s: Column, i: Column) -> Column:
        other = F.get(b, i)
        places = F.transform(s["paragraphs"], lambda p, j: F.when(F.coalesce(F.get(other["paragraphs"], j)["hash"] != p["hash"], F.lit(True)), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"))))
        return F.when(F.coalesce(other["hash"] == s["hash"], F.lit(False)), none).otherwise(F.filter(places, lambda x: x.isNotNull()))

    return F.flatten(F.transform(a, inside))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and next_text: the text of the row after it in descending key (then by text), and
    for the last row the first one's; null keys come last.

    Rows are dealt by ranges of the key, as many as twice the shuffle partitions, and each range
    also gets a copy of the next range's first row, so each text moves once and no task sees all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), text_of(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("__k"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("__k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("__part", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("__k"))))
    # at most as many rows as ranges
    firsts = [(r[0], r[1]) for r in rows.groupBy("__part").agg(F.max("__k")).orderBy(F.desc("__part")).collect()]
    before = [p for p, _ in firsts[-1:] + firsts[:-1]]
    edges = spark.range(1).select(F.inline(F.arrays_zip(F.lit([k for _, k in firsts] or [0]).cast("array<bigint>").alias("__k"), F.lit(before or [0]).cast("array<int>").alias("__to"))))
    dealt = rows.join(F.broadcast(edges), "__k", "left").withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("copy")), F.struct(F.col("__to").alias("part"), F.lit(True).alias("copy"))))))
    order = Window.partitionBy("__at.part").orderBy("__at.copy", F.desc("__k"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("__at.copy")).select(key, "text", "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (its last half replaced by as much of the
    next row's start), with their likeness and the next row's.

    One row for each row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts are empty texts; an empty text's fingerprint is that of one
    empty paragraph, and two empty texts have likeness 1. Equal texts have equal fingerprints. Rows
    of equal key follow each other by text. A single row is its own next one. Other columns of
    ``docs`` are left out. An empty table gives no rows. Keys must be integers.
    """
    rows = with_next(docs, key, text).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(key, F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("changed"), tree(F.col("next_text")).alias("next"))
    rows = rows.withColumns({"l_own": leaves(F.col("own")), "l_changed": leaves(F.col("changed")), "l_next": leaves(F.col("next"))})
    return rows.select(key, "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("l_own"), F.col("l_changed")).alias("near_edited"), likeness(F.col("l_own"), F.col("l_next")).alias("near_next"))


def oracle() -> str:
    """The same result in DuckDB's SQL, for a table with distinct ids."""

    def tree_sql(c: str) -> str:
        leaf = f"list_transform(regexp_extract_all(p, '{CLAUSE}'), lambda x: sha256(x))"
        paragraph = f"list_transform([{leaf}], lambda l: {{'hash': left(sha256(array_to_string(l, '')), {BRANCH}), 'leaves': list_transform(l, lambda x: left(x, {LEAF}))}})[1]"
        section = f"list_transform(string_split(s, chr(10)), lambda p: {paragraph})"
        return f"list_transform(list_transform(string_split({c}, chr(10) || chr(10)), lambda s: {section}), lambda ps: {{'hash': left(sha256(array_to_string(list_transform(ps, lambda p: p.hash), '')), {BRANCH}), 'paragraphs': ps}})"

    def print_sql(c: str) -> str:
        inner = "array_to_string(list_transform(s.paragraphs, lambda p: p.hash || '[' || array_to_string(p.leaves, '.') || ']'), '')"
        return f"sha256(array_to_string(list_transform({c}, lambda s: s.hash), '')) || '#' || array_to_string(list_transform({c}, lambda s: s.hash || '(' || {inner} || ')'), '')"

    def leaves_sql(c: str) -> str:
        return f"list_distinct(flatten(list_transform({c}, lambda s: flatten(list_transform(s.paragraphs, lambda p: p.leaves)))))"

    def like_sql(a: str, b: str) -> str:
        return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) AS DOUBLE) END"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
    e AS (SELECT doc_id, t, nt, length(t) AS n, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS ed FROM n),
    r AS (SELECT doc_id, n, sha256(ed) AS edited_sha256, {tree_sql('t')} AS a, {tree_sql('ed')} AS b, {tree_sql('nt')} AS c FROM e),
    l AS (SELECT *, {leaves_sql('a')} AS la, {leaves_sql('b')} AS lb, {leaves_sql('c')} AS lc FROM r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, {print_sql('a')} AS fingerprint, {print_sql('b')} AS edited_fingerprint,
    CAST({like_sql('la', 'lb')} AS DOUBLE) AS near_edited, CAST({like_sql('la', 'lc')} AS DOUBLE) AS near_next FROM l"""
