"""A trie of conversation prefixes, merged family first.

Conversations whose ids share a base (``id - id % family``) are brought together by that base, so
that one task rebuilds each of them from the base conversation's first turns and its own, and builds
the family's small trie. Only its combined nodes (16 bytes of digest, counts) are shuffled on, by
digest, and merged globally. Sums over subtrees go the same way back: every node is owned by the
family of its smallest member, whose trie holds all of the node's ancestors; a family adds up what
its own nodes give along its own paths, and the families' sums are added by node. So no step goes
through the levels of the global trie.

Turns are numbered and compared by the SHA-256 of role and text, taken before the first shuffle, so
texts are never moved. A family's rows are read in order, one level after another, with a state of one digest a
conversation, however long conversations are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import stored, stream_batches, text_of

#: Conversations of a family have ids in a range of this size; a child takes fewer than SHARED turns of the base.
FAMILY, SHARED = 20, 4
#: Parents with this share of all nodes, or more, as children are joined by broadcast: at most as many.
FREQUENT = 1000
#: Families whose lists of ends are joined before the lists of one node meet.
FAMILIES = 1024
_ROOT = b""
_WORD = r"[^\x20\x09-\x0D]+"


def family_of(conv: Column, family: int = FAMILY) -> Column:
    return conv - conv % family


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """family, conv, place (from 0, by turn, null first, then by digest), digest, words, shared (the
    turns of the base that the conversation begins with), dealt by family."""
    said = F.concat(F.length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        family_of(F.col(conv).cast("long"), family).alias("family"),
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.regexp_count(text_of(text), F.lit(_WORD)).cast("long").alias("words"),
    )
    place = F.row_number().over(Window.partitionBy("family", "conv").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    head = (F.crc32(F.col("conv").cast("string")) % shared).alias("shared")
    return rows.repartition("family").select("family", "conv", place.cast("long").alias("place"), "digest", "words", head)


_NODES = "family bigint, node binary, parent binary, depth bigint, conv bigint, n_convs bigint, words bigint, ends string"


class FamilyTrie:
    """Builds the tries of families from rows in the order of family, place."""

    def __init__(self):
        self.family, self.place, self.level = None, 0, {}
        self.live: dict[int, list] = {}
        self.ended: list[tuple[bytes, int]] = []
        self.out: dict[str, list] = {}
        self._clear()

    def _clear(self) -> dict[str, list]:
        made, self.out = self.out, {c.split()[0]: [] for c in _NODES.split(", ")}
        return made

    def _emit(self, *row) -> None:
        for column, v in zip(self.out.values(), row):
            column.append(v)

    def add(self, batch: dict[str, list]) -> dict[str, list]:
        for family, conv, place, digest, words, shared in zip(*(batch[c] for c in ("family", "conv", "place", "digest", "words", "shared"))):
            if family != self.family:
                self._close()
                self.family, self.place = family, 0
            elif place != self.place:
                self._grow()
                self.place = place
            self.level[conv] = (digest, words)
            if place == 0:
                self.live[conv] = [_ROOT, 0, shared]
        return self._clear()

    def _grow(self) -> None:
        """Adds the turns at one place to the conversations: the base's while they share it, then their own."""
        if self.place == 0:
            self._emit(self.family, _ROOT, None, 0, min(self.live), len(self.live), 0, None)
        grown: dict[bytes, list] = {}
        base = self.level.get(self.family)
        for conv in sorted(self.live):
            state = self.live[conv]
            given = base if self.place < state[2] else self.level.get(conv)
            if given is not None:
                node = hashlib.blake2b(state[0] + given[0], digest_size=16).digest()
                grown.setdefault(node, [state[0], state[1] + 1, conv, 0, given[1]])[3] += 1
                state[:2] = node, state[1] + 1
            elif self.place >= state[2]:
                self.ended.append((state[0], conv))
                del self.live[conv]
        for node, (parent, depth, conv, n, words) in grown.items():
            self._emit(self.family, node, parent, depth, conv, n, words, None)
        self.level = {}

    def _close(self) -> None:
        """A family's last level, and where its conversations end."""
        if self.family is None:
            return
        self._grow()
        at: dict[bytes, list] = {}
        for node, conv in (*self.ended, *((s[0], conv) for conv, s in self.live.items())):
            at.setdefault(node, []).append(conv)
        for node, convs in at.items():
            self._emit(self.family, node, None, None, None, None, None, ",".join(map(str, sorted(convs))))
        self.live, self.ended = {}, []

    def rest(self) -> dict[str, list]:
        self._close()
        return self._clear()


class FamilySums:
    """Adds up leaves and saved tokens along a family's paths, from rows in the order of family and
    depth, deepest first."""

    def __init__(self):
        self.at, self.level, self.below = None, {}, {}
        self.out = {"node": [], "n_leaves": [], "saved_tokens": []}

    def add(self, batch: dict[str, list]) -> dict[str, list]:
        for family, depth, node, parent, leaves, saved in zip(*(batch[c] for c in ("family", "depth", "node", "parent", "leaves", "saved"))):
            if (family, depth) != self.at:
                self._close()
                if self.at is None or self.at[0] != family:
                    self.below = {}
                self.at, self.level = (family, depth), {n: [None, *v] for n, v in self.below.items()}
                self.below = {}
            entry = self.level.setdefault(node, [None, 0, 0])
            entry[0] = parent if parent is not None else entry[0]
            entry[1] += leaves
            entry[2] += saved
        made, self.out = self.out, {c: [] for c in self.out}
        return made

    def _close(self) -> None:
        for node, (parent, leaves, saved) in self.level.items():
            if leaves or saved:
                for column, v in zip(self.out.values(), (node, leaves, saved)):
                    column.append(v)
                if parent is not None:
                    up = self.below.setdefault(parent, [0, 0])
                    up[0] += leaves
                    up[1] += saved
        self.level = {}

    def rest(self) -> dict[str, list]:
        self._close()
        return self.out


def _ends(tries: DataFrame) -> DataFrame:
    """node, ends_sha256 of the ids of the conversations that end at it, ascending. Lists of families
    that follow each other are joined first; a node's joined lists are then hashed as they come."""
    block = F.floor(F.col("family") / (FAMILIES * FAMILY)).alias("block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "ends"))), lambda x: x["ends"]), ",")
    blocks = tries.filter(F.col("ends").isNotNull()).groupBy("node", block).agg(joined.alias("ends"))

    def make():
        state = [None, None]

        def done() -> tuple[list, list]:
            return ([state[0]], [state[1].hexdigest()]) if state[1] else ([], [])

        def add(b: dict[str, list]) -> dict[str, list]:
            nodes, digests = [], []
            for node, ends in zip(b["node"], b["ends"]):
                if state[1] is None or node != state[0]:
                    n, d = done()
                    nodes, digests = nodes + n, digests + d
                    state[:] = node, hashlib.sha256(ends.encode())
                else:
                    state[1].update(b"," + ends.encode())
            return {"node": nodes, "ends_sha256": digests}

        return add, lambda: dict(zip(("node", "ends_sha256"), done()))

    return stream_batches(blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ends"), make, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first crc32(c) % ``shared`` turns of conversation
    c - c % ``family`` and its own turns after as many. Null roles and texts are empty; null turns
    come first; rows of one turn number follow each other by the digest of role and text, and
    repeated rows are turns of their own. Rows with a null id belong to no conversation. A
    conversation may be turnless after rebuilding. Very long texts and conversations are read whole.
    Other columns are left out, so none can clash. An empty table has no nodes, no root either.
    """
    rows = turns_of(conversations, conv, turn, role, text, family, shared).sortWithinPartitions("family", "place")

    def grow():
        trie = FamilyTrie()
        return trie.add, trie.rest

    tries = stored(stream_batches(rows, grow, _NODES), "trie-families")
    merged = tries.filter(F.col("ends").isNull()).groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"))
    merged = stored(merged, "trie-nodes")
    children = merged.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")

    own = nodes.select(family_of(F.col("conv_id"), family).alias("family"), "depth", "node", F.lit(None).cast("binary").alias("parent"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    paths = tries.filter(F.col("ends").isNull()).select("family", "depth", "node", "parent", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))

    def climb():
        sums = FamilySums()
        return sums.add, sums.rest

    given = own.filter("leaves > 0 OR saved > 0").unionByName(paths).repartition("family").sortWithinPartitions("family", F.desc("depth"))
    totals = stream_batches(given, climb, "node binary, n_leaves bigint, saved_tokens bigint").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # a parent of very many nodes would be one join key's task
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    often = F.col("n_children") * FREQUENT >= nodes.count()
    frequent = F.broadcast(parents.filter(often).drop("n_children"))
    known = nodes.join(frequent, "parent").unionByName(nodes.join(frequent, "parent", "left_anti").join(parents.filter(~often).drop("n_children"), "parent", "left"))

    out = known.join(totals, "node").join(_ends(tries), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(CAST(c AS VARCHAR)))), lambda acc, k: xor(xor(acc, CASE WHEN k % 8 = 0 THEN ord(CAST(c AS VARCHAR)[k // 8 + 1])::BIGINT ELSE 0 END) >> 1,
    3988292384 * (xor(acc, CASE WHEN k % 8 = 0 THEN ord(CAST(c AS VARCHAR)[k // 8 + 1])::BIGINT ELSE 0 END) & 1))), 4294967295)"""


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    return f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, {{'r': r, 'x': x}} AS v, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) - 1 AS i FROM t),
    h AS (SELECT c, {_CRC} % {SHARED} AS h FROM (SELECT DISTINCT c FROM n)),
    g AS (SELECT h.c, 0 AS o, i, v FROM h JOIN n ON n.c = h.c - h.c % {FAMILY} AND i < h UNION ALL SELECT h.c, 1, i, v FROM h JOIN n ON n.c = h.c AND i >= h),
    s AS (SELECT h.c, coalesce(any_value(q.s), []) AS s FROM h LEFT JOIN (SELECT c, list(v ORDER BY o, i) AS s FROM g GROUP BY c) q ON q.c = h.c GROUP BY h.c),
    p AS (SELECT c, d, len(s) = d AS ends, s[1:d] AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
    m AS (SELECT c, d, ends, min(c) OVER (PARTITION BY p, d) AS k, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\\x20\\x09-\\x0D]+')) END AS words FROM p),
    u AS (SELECT k, d, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e FROM m GROUP BY k, d),
    f AS (SELECT u.*, m.k AS parent FROM u LEFT JOIN m ON m.c = u.k AND m.d = u.d - 1),
    b AS (SELECT parent AS k, d - 1 AS d, count(*) AS b FROM f WHERE parent IS NOT NULL GROUP BY ALL),
    w AS (SELECT f.*, coalesce(b, 0) AS b FROM f LEFT JOIN b USING (k, d)),
    a AS (SELECT m.k, m.d, count(*) FILTER (w.b = 0) AS leaves, CAST(sum((w.n - 1) * w.words) AS BIGINT) AS saved FROM w JOIN m ON m.c = w.k AND m.d <= w.d GROUP BY ALL)
    SELECT w.k AS conv_id, w.d AS depth, parent AS parent_conv_id, n AS n_convs, b AS n_children, leaves AS n_leaves, saved AS saved_tokens, e AS ends_sha256 FROM w JOIN a USING (k, d)"""
