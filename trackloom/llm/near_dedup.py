"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a document's set holds its
distinct word shingles. Documents with the same words form a class, and only one row a class goes
on. Signatures are cut into bands; classes that share a band's values are candidates. A candidate
pair's signatures are compared batch by batch, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls under the chosen miss probability.
Survivors are verified on the full shingle sets of their texts.

No bucket's members are paired all with all. In each of a few turns, every bucket that holds more
than one component names one member, its hub, and each class asks one hub only, so a turn makes no
more pairs than there are classes; verified links merge components. Classes whose buckets are still
open meet by their rarest shingles: two sets of the wanted similarity share one of the first
n - ceil(similarity x n) + 1 shingles in any common order, and what follows the first one bounds
their intersection, so texts that share a frequent passage only drop out. What is left is compared in cells of bounded bytes, which emit links alone; nothing
is capped.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import give_back, map_batches, scratch, stored, text_of
from trackloom.session import ship_package

#: Signature values compared at once, and their number.
BATCH, HASHES = 32, 192
#: Values in a band; each permutation of the signature is cut into bands of them.
ROWS, PERMUTATIONS = 8, 5
#: Turns in which each class asks one hub; turns end when fewer than one in YIELD asked pairs links.
TURNS, YIELD = 6, 4
#: Bytes of words in a block; a cell compares one block with itself or with another one.
CELL_BYTES = 2 << 20
#: Rows up to which one side of a join (ids, labels, pairs) is broadcast; longer ones are joined by
#: shuffle. Spark's own choice goes by the size of files, whose ids take some ten times that in memory.
BROADCAST_ROWS = 50_000

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(1, 2**32, HASHES, np.uint32) | 1).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, HASHES, np.uint32)
_BYTES = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[32] = 0  # the space between words
_ORDER = np.concatenate([np.arange(HASHES), *(_rng.permutation(HASHES) for _ in range(PERMUTATIONS - 1))])
BANDS = PERMUTATIONS * HASHES // ROWS


def words_of(text: str) -> list[bytes]:
    """The words, lower-cased in A-Z, cut at bytes 9 to 13 and 32."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], k: int) -> set:
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(2)
def _powers(size: int) -> np.ndarray:
    """Factors of a word's first ``size`` places."""
    out = np.empty(size, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(out) - 1, 0xD6E8FEB86659FD93, np.uint64), out=out[1:])
    return out


def shingle_hashes(joined: bytes, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of words joined by one space."""
    if not joined:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    within = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    with np.errstate(over="ignore"):
        longest = int(within.max()) + 1
        values = _BYTES[raw] * _powers(max(1 << 12, 1 << (longest - 1).bit_length()))[within]
        words = _mix(np.add.reduceat(values, starts))
        k = min(k, len(words))
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = _mix(out * np.uint64(0xBF58476D1CE4E5B9) + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        h = (x[i : i + 4096, None] ^ _XOR) * _MUL
        h ^= h >> np.uint32(15)
        np.minimum(best, (h * np.uint32(0x2C1B3C6D)).min(0), out=best)
    return best


def least_matches(similarity: float, miss: float) -> np.ndarray:
    """For each batch end, the fewest equal values at which the pair goes on: with a flat prior, the
    posterior of the similarity after m of n equal values is Beta(m + 1, n - m + 1)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(logs - logs.max())
            if p[grid >= similarity].sum() / p.sum() >= miss:
                break
        out.append(m)
    return np.array(out)


def describe(docs: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """key, n_shingles, class_id (of the word sequence, 16 bytes), signature; the last two are null
    without words."""
    rows = docs.select(F.col(key), text_of(text).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def make():
        def work(b):
            n, ids, sigs = [], [], []
            for t in b["__text"]:
                words = words_of(t)
                joined = b" ".join(words)
                h = shingle_hashes(joined, k)
                n.append(len(shingle_set(words, k)))
                ids.append(xxhash.xxh3_128_digest(joined) if joined else None)
                sigs.append(signature(h).tobytes() if joined else None)
            return {key: b[key], "n_shingles": n, "class_id": ids, "signature": sigs}

        return work

    return map_batches(rows, make, f"`{key}` {kind}, n_shingles bigint, class_id binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """bucket (64-bit, of the band's place and values), rep, n."""

    def make():
        places = np.arange(1, BANDS + 1, dtype=np.uint64)

        def work(b):
            sigs = np.frombuffer(b"".join(b["signature"]), np.uint32).reshape(-1, HASHES)[:, _ORDER].reshape(-1, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = np.broadcast_to(_mix(places * np.uint64(0x94D049BB133111EB)), sigs.shape[:2]).copy()
                for i in range(ROWS):
                    h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + sigs[:, :, i])
            return {"bucket": h.astype(np.int64).ravel(), "rep": np.repeat(np.array(b["rep"], np.int64), BANDS), "n": np.repeat(np.array(b["n"], np.int64), BANDS)}

        return work

    return map_batches(classes.select("rep", "n", "signature"), make, "bucket bigint, rep bigint, n bigint")


def _marked(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows: broadcast in a join if they are few, else only shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _few(df: DataFrame) -> DataFrame:
    """``df``, which is stored, marked for its join."""
    return _marked(df, df.count())


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it reaches, over ``edges`` (a, b): labels spread to neighbours and
    jump to their label's label until nothing changes; each step is stored."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "dedup-labels")
    nodes = labels.count()
    while True:
        near = both.join(_marked(labels.withColumnRenamed("node", "b"), nodes), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = _marked(labels, nodes).join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        spread = stored(spread, "dedup-spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(spread.join(_marked(jump, nodes), "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "dedup-labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _survivors(pairs: DataFrame, signatures: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Pairs (a, b, ca, cb) that the sequential comparison keeps."""
    least = least_matches(similarity, miss)
    left, right = (signatures.select(F.col("rep").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    rows = _few(pairs).join(left, "a").join(right.hint("merge"), "b")

    def make():
        def work(b):
            x, y = (np.frombuffer(b"".join(b[s]), np.uint32).reshape(-1, HASHES) for s in ("sig_a", "sig_b"))
            at = _compared(x, y, least)
            return {c: np.array(b[c], np.int64)[at] for c in ("a", "b", "ca", "cb")}

        return work

    return map_batches(rows.select("a", "b", "ca", "cb", "sig_a", "sig_b"), make, "a bigint, b bigint, ca bigint, cb bigint")


def _compared(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places of the pairs of signatures that no batch drops."""
    at, matches = np.arange(len(x)), np.zeros(len(x), int)
    for i, m in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[at] += (x[at, part] == y[at, part]).sum(1)
        at = at[matches[at] >= m]
    return at


def linked(x: set, y: set, percent: int) -> bool:
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 x intersection >= percent x union."""
    ids = _few(stored(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "dedup-ids"))
    few = texts.join(ids, "rep", "left_semi")
    left, right = (few.select(F.col("rep").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")

    def make():
        last: list = [None, None]

        def work(b):
            out: dict[str, list] = {c: [] for c in ("a", "b", "ca", "cb")}
            for i, (x, y) in enumerate(zip(b["words_a"], b["words_b"])):
                if last[0] != b["b"][i]:
                    last[:] = b["b"][i], shingle_set(y.encode().split(b" "), k)
                if linked(shingle_set(x.encode().split(b" "), k), last[1], percent):
                    for c in out:
                        out[c].append(b[c][i])
            return out

        return work

    rows = _few(pairs).join(left, "a").join(right.hint("merge"), "b").select("a", "b", "ca", "cb", "words_a", "words_b")
    return map_batches(rows, make, "a bigint, b bigint, ca bigint, cb bigint")


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (bucket, rep, n, comp) of the buckets that hold more than one component, stored."""
    now = members.withColumn("comp", F.col("rep")) if labels is None else members.drop("comp").join(_few(labels.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    if labels is None:
        return now
    several = stored(now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket"), "dedup-several")
    return stored(now.join(_few(several), "bucket"), "dedup-open")


def _asks(now: DataFrame, turn: int, percent: int) -> DataFrame:
    """One hub for each class that shares a bucket with one of another component: a, b and their
    components ca, cb. Hubs are the members of least hash, another hash in each turn, so that most
    of a group's members ask the same few."""
    rows = now.withColumn("u", F.xxhash64("rep", F.lit(turn)))
    hubs = stored(rows.groupBy("bucket").agg(F.min(F.struct("u", "rep", "n", "comp")).alias("hub")), "dedup-hubs")
    n, m = F.col("n"), F.col("hub.n")
    fits = (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.col("comp") != F.col("hub.comp"))
    best = rows.join(_few(hubs), "bucket").filter(fits).groupBy("rep", "comp").agg(F.min("hub").alias("hub"))
    return best.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.col("comp").alias("ca"), F.col("hub.comp").alias("cb"))


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """node, label after the links ``found`` between components."""
    new = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if labels is None:
        return new
    rows = labels.withColumnRenamed("label", "old").join(_few(new.select(F.col("node").alias("old"), "label")), "old", "left")
    rows = rows.select("node", F.coalesce("label", "old").alias("label"))
    # components of one class come in with their first link
    return stored(rows.union(new.join(_few(labels.select("node")), "node", "left_anti").select("node", "label")), "dedup-labels")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rare_keys(reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """h, rep, comp, bytes: the shingles among a class's rarest that it must share with any partner,
    of those that several components hold. Rarity is counted over ``reps`` (rep, comp)."""

    def make():
        def work(b):
            hashes = [shingle_hashes(w.encode(), k) for w in b["words"]]
            return {"rep": b["rep"], "comp": b["comp"], "bytes": [len(w.encode()) for w in b["words"]], "hs": [h.view(np.int64) for h in hashes]}

        return work

    rows = texts.join(_few(reps), "rep").select("rep", "comp", "words")
    sets = stored(map_batches(rows, make, "rep bigint, comp bigint, bytes bigint, hs array<bigint>"), "dedup-sets").withColumn("n", F.size("hs"))
    tokens = sets.select("rep", F.explode("hs").alias("h"))
    common = stored(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "dedup-common")
    ranked = tokens.join(_few(common), "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    # shingles that no other class has come first and need no key; the rest of the order bounds what
    # a pair can share from its first common shingle on
    alone = F.col("n") - F.size("shared")
    keys = sets.drop("hs").join(ranked.hint("merge"), "rep").withColumn("alone", alone).withColumn("ahead", F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone).filter("ahead > 0")
    keys = keys.select("rep", "comp", "bytes", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("ahead"))).alias("at", "x"))
    keys = stored(keys.select(F.col("x.h").alias("h"), "rep", "comp", "bytes", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest")), "dedup-keys")
    # an intersection of (percent x (n + m)) / (100 + percent) is within reach of both sides
    reach = (100 + percent) * F.col("rest") - percent * F.col("n")
    bounds = keys.groupBy("h").agg(F.min("n").alias("least"), F.max(reach).alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h", "least", "most")
    keys = keys.join(_few(stored(bounds, "dedup-bounds")), "h").filter((F.col("most") >= percent * F.col("n")) & (reach >= percent * F.col("least")))
    keys = stored(keys.select("h", "rep", "comp", "bytes"), "dedup-keys")
    several = stored(keys.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("first")).filter("lo <> hi").select("h", "first"), "dedup-several")
    return keys.join(_few(several), "h")


def numbered_sets(words: list[str], k: int) -> tuple[list[np.ndarray], int]:
    """Each text's distinct shingles as numbers that stand for the same words in all of them, and how
    many numbers there are. Words are numbered, then beginnings of shingles word by word."""
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in words for w in t.split(" ")), np.int64)
    ends = np.cumsum([t.count(" ") + 1 for t in words])
    begun = flat
    for i in range(1, k):
        begun = np.unique(begun * len(ids) + np.append(flat[i:], np.zeros(min(i, len(flat)), np.int64)), return_inverse=True)[1]
    top = int(begun.max()) + 1 if len(begun) else 0
    short: dict[str, int] = {}
    out = []
    for t, start, end in zip(words, [0, *ends[:-1]], ends):
        out.append(np.unique(begun[start : end - k + 1]) if end - start >= k else np.array([top + short.setdefault(t, len(short))]))
    return out, top + len(short)


def _cell_links(table: pa.Table, k: int, percent: int, least: np.ndarray) -> pa.Table:
    """Links between components of one cell's rows (rep, comp, side, words, signature): from rarest
    shingles by the cell's own counts to signatures to the sets themselves. Components that a link
    joins are one from then on."""
    sides = np.array(table["side"].to_pylist())
    words, comps, reps = table["words"].to_pylist(), table["comp"].to_pylist(), table["rep"].to_pylist()
    sigs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
    sets, total = numbered_sets(words, k)
    counts = np.bincount(np.concatenate(sets), minlength=total)
    size = np.array([len(x) for x in sets])
    keys, rests = [], []
    for own in sets:
        first = own[np.lexsort((own, counts[own]))][: prefix_length(len(own), percent)]
        alone = int((counts[first] == 1).sum())
        keys.append(first[alone:])
        rests.append(len(own) - alone - np.arange(len(first) - alone))
    # rows of each key, in order
    owner, flat = np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    owner, rest, ends = owner[order], np.concatenate(rests)[order], np.cumsum(np.bincount(flat, minlength=len(counts)))
    cross = bool(sides.any() and not sides.all())
    label = np.unique(comps, return_inverse=True)[1]
    met, marked = np.zeros(len(keys), bool), np.zeros(total, bool)
    out: dict[str, list] = {c: [] for c in ("a", "b", "ca", "cb")}
    for i, own in enumerate(keys):
        met[:] = False
        for h, left in zip(own.tolist(), rests[i].tolist()):
            at = slice(ends[h - 1] if h else 0, ends[h])
            rows = owner[at]
            met[rows[(100 + percent) * np.minimum(rest[at], left) >= percent * (size[rows] + size[i])]] = True
        js = np.flatnonzero(met[:i] & (label[:i] != label[i]))
        js = js[(size[js] * 100 >= percent * size[i]) & (size[i] * 100 >= percent * size[js])]
        js = js[sides[js] != sides[i]] if cross else js
        marked[sets[i]] = True
        for j in js[_compared(np.broadcast_to(sigs[i], (len(js), HASHES)), sigs[js], least)].tolist():
            if label[i] == label[j]:
                continue
            common = int(marked[sets[j]].sum())
            if 100 * common >= percent * (size[i] + size[j] - common):
                label[label == label[j]] = label[i]
                for name, v in zip(out, (reps[i], reps[j], comps[i], comps[j])):
                    out[name].append(v)
        marked[sets[i]] = False
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def _in_cells(keys: DataFrame, texts: DataFrame, signatures: DataFrame, k: int, percent: int, least: np.ndarray) -> DataFrame:
    """Links among the classes of ``keys``. Classes that shared rare shingles connect form a cluster;
    a cluster within CELL_BYTES lies in one cell with other small ones, a larger one is dealt into
    blocks, and each two of its blocks meet in one cell."""
    clusters = components(keys.select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    own = stored(keys.select("rep", "comp", "bytes").distinct().join(_few(clusters), "rep"), "dedup-clustered")
    sizes = stored(own.groupBy("cluster").agg(F.ceil(F.sum("bytes") / CELL_BYTES).alias("blocks")), "dedup-sizes")
    total = own.agg(F.sum("bytes")).first()[0] or 0
    cells = max(1, -(-total // CELL_BYTES))
    dealt = own.join(_few(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    small = F.array(F.struct(F.lit(-1).cast("bigint").alias("cluster"), F.pmod(F.xxhash64("cluster"), F.lit(cells)).alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0).alias("side")))
    meet = lambda j: F.struct(F.col("cluster"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).cast("int").alias("side"))
    large = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), meet)
    rows = dealt.withColumn("cell", F.explode(F.when(F.col("blocks") <= 1, small).otherwise(large))).select("rep", "comp", "cell.cluster", "cell.i", "cell.j", "cell.side")
    ids = _few(own.select("rep"))
    rows = rows.join(texts.join(ids, "rep", "left_semi").hint("merge"), "rep").join(signatures.join(ids, "rep", "left_semi").hint("merge"), "rep")
    ship_package(keys.sparkSession)

    def links(cell: pa.Table) -> pa.Table:
        out = _cell_links(cell, k, percent, least)
        give_back()
        return out

    return rows.groupBy("cluster", "i", "j").applyInArrow(links, "a bigint, b bigint, ca bigint, cb bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    component_id is the smallest key that links of 100 x intersection >= ``percent`` x union reach;
    kept marks the row whose key it is. Null and empty texts, and texts of white space, have no
    shingles and stand alone. With fewer than ``k`` words the whole sequence is the one shingle.
    Rows with equal key appear each; null keys stand outside all groups with a null component_id and
    kept false. Other columns of ``docs`` are left out. The bands are
    permutations of the same values, so they depend on each other: simulated with independent
    values, they miss 3 of 3 million links at 0.8 (1e-6) and none of 500,000 at 0.82. ``miss``
    bounds a posterior; as a frequency at 0.8 the comparison drops 25 of 3 million (8e-6), at 0.82
    2 of 500,000. Keys must be integers. Intermediate folders
    are deleted but for those that the result reads.
    """
    with scratch(docs.sparkSession) as keep:
        out = _near_duplicates(docs, k, percent, miss, text, key)
        keep(out)
    return out


def _near_duplicates(docs: DataFrame, k: int, percent: int, miss: float, text: str, key: str) -> DataFrame:
    least = least_matches(percent / 100, miss)
    described = stored(describe(docs.withColumn(key, F.col(key).cast("long")), k, text, key), "dedup-docs")
    full = described.filter(F.col("class_id").isNotNull() & F.col(key).isNotNull())
    # exact copies meet here, after partial aggregation
    classes = stored(full.groupBy("class_id").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "dedup-classes")
    buckets = bands(classes)
    # what a join below meets is stored first: Spark splits a hot key only between two plain inputs
    shared = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select("bucket"), "dedup-shared")
    members = stored(buckets.join(_few(shared), "bucket"), "dedup-members")
    texts = _texts(docs, stored(members.select("rep").distinct(), "dedup-involved"), text, key)
    signatures = classes.select("rep", "signature")

    labels, now = None, _open(members, None)
    for turn in range(TURNS):
        asked = stored(_asks(now, turn, percent), "dedup-asked")
        number = asked.count()
        if not number:
            break
        found = stored(_verified(stored(_survivors(asked, signatures, percent / 100, miss), "dedup-pairs"), texts, k, percent), "dedup-verified")
        links = found.count()
        if links:
            labels = _merged(labels, found)
            now = _open(now, labels)
        if links * YIELD < number:
            break
    reps = stored(now.select("rep", "comp").distinct(), "dedup-open")
    if reps.limit(1).count():
        found = stored(_in_cells(stored(_rare_keys(reps, texts, k, percent), "dedup-keys"), texts, signatures, k, percent, least), "dedup-verified")
        if found.limit(1).count():
            labels = _merged(labels, found)

    own = classes.select("class_id", "rep")
    groups = own.withColumn("__component", F.col("rep")) if labels is None else own.join(_few(labels.withColumnRenamed("node", "rep")), "rep", "left").withColumn("__component", F.coalesce("label", "rep"))
    out = described.drop("signature").join(_marked(groups.select("class_id", "__component"), own.count()), "class_id", "left")
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("__component", F.col(key))).alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _texts(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """rep and its words (lower case, joined by one space), stored, of the documents in ``ids``."""
    space = r"[\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.translate(F.btrim(F.regexp_replace(text_of(text), space, " ")), upper, lower)
    rows = docs.select(F.col(key).cast("long").alias("rep"), words.alias("words")).join(_few(ids), "rep", "left_semi")
    return stored(rows, "dedup-texts")
