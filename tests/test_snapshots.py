"""Commits as one unit under concurrency, and three-way sync, against plain versions."""

import hashlib
import random

from trackloom.operators import snapshots, sync

OPS = "op string, path string, sha string, size long, prev string"


def sha(x) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


def blobs(spark, *names):
    return spark.createDataFrame([(sha(n),) for n in names], "sha string")


def put(path, content, prev=None):
    return ("put", path, "" if path.endswith("/") else sha(content), 0 if path.endswith("/") else 1, prev)


def files(lib):
    return {r.path: r.sha for r in lib.read().collect()}


def test_a_commit_is_one_unit(spark, tmp_path):
    lib, have = snapshots.Library(spark, f"file://{tmp_path}"), blobs(spark, "a", "b", "c")
    do = lambda *ops, user=1: lib.commit(spark.createDataFrame(list(ops), OPS), have, user)
    assert do(put("S/m.csv", "a"), put("S/", "")).status == "ok" and lib.version() == 1
    for ops, status in (
        ([put("S/n.csv", "b"), put("S/m.csv", "b")], "conflict"),  # one is against an older state
        ([put("S/n.csv", "b"), put("S/o.csv", "gone")], "missing"),
        ([put("S/n.csv", "b"), ("put", "S/../x.csv", sha("b"), 1, None)], "invalid"),
        ([put("S/n.csv", "b"), put("S/n.csv", "c")], "invalid"),
        ([put("S/n.csv", "b"), ("put", "S/q.csv", "short", 1, None)], "invalid"),
        ([put("S/ n.csv", "b")], "invalid"),
    ):
        got = do(*ops)
        assert (got.status, got.version) == (status, 1) and got.refused.count() >= 1
        assert files(lib) == {"S/m.csv": sha("a"), "S/": ""}
    other = do(("delete", "S/m.csv", None, None, sha("a")), put("S/n.csv", "b"), user=2)
    assert other.status == "rejected" and files(lib) == {"S/m.csv": sha("a"), "S/": ""}
    assert do(("delete", "S/m.csv", None, None, sha("a")), put("S/n.csv", "b")).version == 2
    assert files(lib) == {"S/n.csv": sha("b"), "S/": ""}
    assert {r.path for r in lib.read(1).collect()} == {"S/m.csv", "S/"}  # older versions stay as they were


def test_a_change_set_of_any_size_where_no_bound_is_set(spark, tmp_path):
    n = snapshots.MOST_OPS + 1
    many = spark.range(n).selectExpr("'put' AS op", "'f' || id || '.csv' AS path", "sha2('a', 256) AS sha", "1L AS size", "CAST(NULL AS string) AS prev")
    have = spark.range(1).selectExpr("sha2('a', 256) AS sha")
    assert snapshots.Library(spark, f"file://{tmp_path}/bounded").commit(many, have, 1).status == "invalid"
    lib = snapshots.Library(spark, f"file://{tmp_path}/open", most_ops=None)
    assert lib.commit(many.limit(0), have, 1).status == "invalid"
    assert lib.commit(many, have, 1).status == "ok" and lib.read().count() == n


def test_writers_on_one_base(spark, tmp_path):
    root, have = f"file://{tmp_path}", blobs(spark, "a", "b", "c")
    first, second = snapshots.Library(spark, root), snapshots.Library(spark, root)
    assert first.commit(spark.createDataFrame([put("m.csv", "a")], OPS), have, 1).status == "ok"

    def beaten(lib, theirs):
        """Another writer commits between this one's reading and claiming."""
        claim, left = lib.claim, list(theirs)

        def late(version, rows):
            if left:
                assert second.commit(spark.createDataFrame([left.pop()], OPS), have, 1).status == "ok"
            return claim(version, rows)

        lib.claim = late
        return lib

    clash = beaten(snapshots.Library(spark, root), [put("m.csv", "b", sha("a"))])
    got = clash.commit(spark.createDataFrame([put("m.csv", "c", sha("a"))], OPS), have, 1)
    assert got.status == "conflict" and [r.path for r in got.refused.collect()] == ["m.csv"] and files(first) == {"m.csv": sha("b")}
    apart = beaten(snapshots.Library(spark, root), [put("x.csv", "a"), put("y.csv", "b")])
    got = apart.commit(spark.createDataFrame([put("z.csv", "c")], OPS), have, 1)  # tries again twice
    assert (got.status, got.version) == ("ok", first.version()) and set(files(first)) == {"m.csv", "x.csv", "y.csv", "z.csv"}
    busy = beaten(snapshots.Library(spark, root), [put(f"p{i}.csv", "a") for i in range(5)])
    got = busy.commit(spark.createDataFrame([put("w.csv", "c")], OPS), have, 1)
    assert got.status == "busy" and "w.csv" not in files(first)


def key_of(path):
    if path.endswith("/"):
        return path
    if ".logs/" in path:
        return path.split(".logs/")[0]
    return path.rsplit(".", 1)[0]


def plain_sync(base, local, remote, owners, have, user, member):
    """The rules in words, one path after another, round by round."""
    base, local = dict(base), dict(local)
    changed_here = {p for p in base.keys() | local if base.get(p) != local.get(p)}
    changed_there = {p for p in base.keys() | remote if base.get(p) != remote.get(p)}
    for p in changed_there - (changed_here if member else set()):
        base[p] = local[p] = remote.get(p)
    ops = {}
    for p in sorted(changed_here) if member else ():
        if local.get(p) == remote.get(p):
            base[p] = local.get(p)
        else:
            ops[p] = local.get(p)
    refused = {}
    while True:
        bad = {}
        for p, mine in ops.items():
            now = remote.get(p)
            if now is not None and not p.endswith("/") and not (mine is not None and p.endswith(".json")):
                if owners.get(key_of(p) + ".csv", owners.get(p)) != user:
                    bad[p] = "rejected"
                    continue
            if mine is not None and not p.endswith("/") and mine not in have:
                bad[p] = "missing"
        if not bad:
            break
        parent = {}

        def find(k):
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        gone = {remote[p]: key_of(p) for p, mine in ops.items() if mine is None and remote.get(p)}
        for p, mine in ops.items():
            if mine is not None and mine in gone and find(key_of(p)) != find(gone[mine]):
                parent[find(key_of(p))] = find(gone[mine])
        vetoed = {find(key_of(p)) for p in bad}
        for p in [p for p in ops if find(key_of(p)) in vetoed]:
            base[p] = local[p] = remote.get(p)
            del ops[p]
        refused |= bad
    after = dict(remote)
    for p, mine in ops.items():
        base[p] = after[p] = mine
    keep = lambda d: {p: s for p, s in d.items() if s is not None}
    return keep(local), keep(base), keep(after), refused


def test_sync_equals_plain_rounds(spark):
    r = random.Random(4)
    for case in range(3):
        paths = [f"S{i % 3}/m{i}{e}" for i in range(12) for e in (".csv", ".json", ".logs/a.txt")] + ["S0/", "S1/", "S2/"]
        pick = lambda share: {p: "" if p.endswith("/") else sha(r.randrange(14)) for p in paths if r.random() < share}
        base = pick(0.7)
        vary = lambda: {p: s for p, s in ({**base, **pick(0.25)}).items() if r.random() > 0.15}
        local, remote = vary(), vary()
        for p in r.sample(sorted(local), 4):  # moves
            if not p.endswith("/"):
                local["S9/" + p.split("/", 1)[1]] = local.pop(p)
        owners = {p: r.randrange(2) for p in remote}
        have = {sha(x) for x in range(14) if x != 3}
        for member in (True, False):
            want = plain_sync(base, local, remote, owners, have, 1, member)
            frame = lambda d: spark.createDataFrame([(p, s, 1) for p, s in d.items()], "path string, sha string, size long")
            theirs = spark.createDataFrame([(p, s, 1, owners[p], False) for p, s in remote.items()], snapshots.MANIFEST)
            got = sync.synced(frame(base).drop("size"), frame(local), theirs, spark.createDataFrame([(h,) for h in have], "sha string"), 1, member)
            state = got.state.collect()
            assert {x.path: x.local for x in state if x.local is not None} == want[0]
            assert {x.path: x.base for x in state if x.base is not None} == want[1]
            assert {x.path: x.sha for x in got.remote.collect()} == want[2]
            assert {x.path: x.status for x in got.refused.collect()} == want[3]
