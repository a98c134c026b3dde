"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every version of every file is addressed by its text's SHA-256. The ledger holds, for each (blob,
rule version) pair that was ever scanned, the spans found; a scan reads only blobs whose pair the
ledger lacks, each once however many paths hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import stored, text_of


def any_case(word: str) -> str:
    """A pattern for an ASCII word with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``, of which group ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int
    least: int


_NAMES = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 or more: the same spans as all runs less the short ones, without listing those
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def version_of(rules: tuple[Rule, ...]) -> int:
    """A number of the rules themselves, so that blobs are scanned again when any rule changes."""
    return zlib.crc32("\n".join(map(repr, rules)).encode()) >> 1


#: Matches of a text whose places are added up at once.
CHUNK = 512


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's spans in code points, end exclusive. The texts
    between matches give their places: lengths are added up within chunks of matches, then over the
    chunks, so the work grows with the number of matches."""
    lengths = lambda texts: F.transform(texts, lambda x: F.length(x))
    whole, judged = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    gaps = F.slice(lengths(F.split(text, rule.pattern, -1)), F.lit(1), F.size(whole))
    rows = F.arrays_zip(gaps.alias("gap"), lengths(whole).alias("size"), lengths(judged).alias("judged"))
    local, span = "array<struct<start:int,end:int,judged:int>>", "struct<start:int,order:int,kind:string,end:int>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        new = F.struct(start.alias("start"), end.alias("end"), x["judged"].alias("judged"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(new)).alias("found"))

    def chunks(all_: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(local).alias("found"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)), begin, step))

    def placed(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
        offsets = F.aggregate(parts, begin, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets")))
        moved = lambda c, o: F.transform(F.filter(c["found"], lambda x: x["judged"] >= rule.least), lambda x: F.struct((x["start"] + o).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (x["end"] + o).alias("end")))
        return F.flatten(F.zip_with(parts, offsets["offsets"], moved))

    return F.when(F.rlike(text, F.lit(rule.pattern)), _let(rows, lambda r: _let(chunks(r), placed))).otherwise(F.array().cast(f"array<{span}>"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` and the ledger's new entries.

    Findings: path, blob, found (array of start, order, kind, end; sorted, empty if none), for each
    row, repeated ones too. Entries: blob, rule_version, found; the caller appends them to the
    ledger it passes next time. A null text is the empty text; null paths are kept. Very long texts
    are scanned whole. Other columns of ``versions`` are left out, so none can clash. An empty table
    gives no findings and no entries.
    """
    version = version_of(rules)
    rows = versions.select(F.col(path), text_of(text).alias("__text")).withColumn("blob", F.sha2("__text", 256))
    blobs = rows.select("blob", "__text")
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    found = F.array_sort(F.flatten(F.array(*(spans_of(F.col("__text"), r, i) for i, r in enumerate(rules)))))
    entries = stored(blobs.dropDuplicates(["blob"]).select("blob", F.lit(version).alias("rule_version"), found.alias("found")), "secret-ledger")
    known = entries if ledger is None else entries.unionByName(ledger.filter(F.col("rule_version") == version))
    some = known.filter(F.size("found") > 0).select("blob", "found")
    none = F.array().cast(some.schema["found"].dataType)
    return rows.select(path, "blob").join(some, "blob", "left").select(path, "blob", F.coalesce("found", none).alias("found")), entries


def digests(findings: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts by kind, the spans as text and the digest of the base rules' spans."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in RULES]
    said = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return findings.select(path, *map(count, base), F.sha2(said(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    lists = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        lists.append(f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: length(regexp_extract_all(t, '{p}', {r.group})[i]) >= {r.least}),
            lambda i: {{'s': coalesce(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i - 1], lambda x: length(x))), 0),
            'o': {i}, 'k': '{r.kind}', 'n': length(regexp_extract_all(t, '{p}', 0)[i])}})""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, list_sort(list_concat({', '.join(lists)})) AS f FROM d),
    j AS (SELECT doc_id, f, array_to_string(list_transform(f, lambda x: x.k || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ',') AS spans FROM f)
    SELECT doc_id, {', '.join(f"CAST(len(list_filter(f, lambda x: x.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in RULES)}, sha256(spans) AS base_sha256, spans FROM j"""
