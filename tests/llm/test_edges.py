"""Edge cases and brute-force versions of the training-data operators and their pipeline."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain_pii
from trackloom.llm import bpe, language_id, near_dedup, packing, pii, toxicity
from trackloom.llm.queries import PSEUDONYM_SECRET

SCHEMA = "doc_id bigint, text string, score double, Predicted string, lang string, clauses int, pii string, bucket int, comp int, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids, columns named like the operators' own."""
    long = "You are an idiot. " + "word of the " * 60_000
    texts = [None, "", "  ", "x", long, long, "call +1 (017) 555-7713 now", "W" * 70_000 + " end"]
    rows = [(i, t, 1.5 + i, "p", "en", 7, "q", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id at all", *rows[0][2:])], SCHEMA)


# toxicity


def _paths(kinds):
    """What read() must say, from the rules in words."""
    out = []
    for kind in ("insult", "threat"):
        at = [i for i, k in enumerate(kinds) if isinstance(k, tuple) and k[0] == kind]
        if at:
            before = kinds[: at[0]]
            context = "reported" if "report" in before else "negated" if "negation" in before else "targeted" if "target" in kinds else "plain"
            out.append(toxicity.label(kind, max(kinds[i][1] for i in at), context))
    return out


def test_grammar_equals_the_rules_on_all_short_clauses():
    weights = {path: 2.0**i for i, path in enumerate(toxicity.PATHS)}
    grammar = toxicity.Grammar(weights)
    for n in range(5):
        for kinds in itertools.product([None, "target", "negation", "report", ("insult", 2), ("insult", 5), ("insult", 7), ("threat", 0)], repeat=n):
            want = _paths(list(kinds))
            assert grammar.read(list(kinds)) == (want, sum(weights[x] for x in want))


def test_composition_reads_as_its_parts_in_turn():
    plain = [(("insult", 3), "plain"), (("insult", 6), "plain"), (("threat", 0), "plain")]
    symbols = ["target", "negation", "report", *plain]
    first, second = toxicity.scope("negation", "negated"), toxicity.first_of("insult", {"plain/3": 1.0, "negated/3": 3.0, "plain/6": 5.0})
    both = toxicity.compose(first, second, symbols)
    for word in itertools.product(symbols, repeat=4):
        a, b, ab, w1, w2 = first.start, second.start, both.start, 0.0, 0.0
        for symbol in word:
            a, passed, v = first.step(a, symbol)
            w1 += v
            if passed is not None:
                b, _, v = second.step(b, passed)
                w1 += v
            ab, _, v = both.step(ab, symbol)
            w2 += v
        assert ab == (a, b) and w1 == w2


def test_score_is_the_clauses_paths():
    """A plain reading of words and clauses, and the logistic of what the paths add up to."""
    model = {"weights": {"idiot": 6.2, "dumm*": 2.6, "fool": 9.0}, "paths": {x: (i % 7) / 3 - 0.5 for i, x in enumerate(toxicity.PATHS)}, "bias": -2.0}
    lexicon, grammar, r = toxicity.Lexicon(model["weights"]), toxicity.Grammar(model["paths"]), np.random.default_rng(2)
    known = {"idiot": ("insult", 6), "dummes": ("insult", 3), "fool": ("insult", 7), "kill": ("threat", 0), "you": "target", "not": "negation", "said": "report"}
    for _ in range(400):
        clauses = [[str(w) for w in r.choice([*known, "room", "of", "the"], r.integers(1, 7))] for _ in range(r.integers(1, 6))]
        text = ". ".join(" ".join(c) for c in clauses) + "."
        total = sum(model["paths"][x] for c in clauses for x in _paths([known.get(w) for w in c]))
        score, found = toxicity.score_of(text, model, lexicon, grammar)
        assert abs(score - 1 / (1 + np.exp(2.0 - 1000 / (len(text) + toxicity.SHORT) * total))) < 1e-12
        assert [text[c[0] : c[1]].strip() for c in found] == [" ".join(c) for c in clauses if any(isinstance(known.get(w), tuple) for w in c)]


def test_held_out_results_come_through_the_paths(spark):
    """Without the paths' weights nothing is found; with them most toxic rows are, and few clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").filter(~language_id.in_training()).select("doc_id", "text", "toxic")
    count = lambda m: {(r.toxic, r.predicted): r["count"] for r in toxicity.score(held, m).groupBy("toxic", "predicted").count().collect()}
    found, none = count(model), count(model | {"paths": {}})
    assert found[1, 1] >= 0.92 * (found[1, 1] + found[1, 0]) and found.get((0, 1), 0) <= 0.006 * found[0, 0]
    assert none.get((1, 1), 0) == none.get((0, 1), 0) == 0
    # the same insult weighs by its clause's context
    paths = model["paths"]
    assert paths["plain/5"] > paths["negated/5"] and paths["plain/3"] > paths["targeted/3"]


def test_toxicity_edges(spark, odd):
    model = {"weights": {"idiot": 6.0}, "paths": {"targeted/6": 9000.0}, "bias": -4.0}
    got = toxicity.score(odd, model)
    assert {c.lower() for c in got.columns} >= {c.lower() for c in odd.columns} and got.count() == odd.count()
    rows = [r.asDict() for r in got.collect()]
    none = 1 / (1 + np.exp(4.0))
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] in (4, 5):
            assert r["predicted"] == 1 and [c.context for c in r["clauses"]] == ["targeted/6"]
        else:
            assert abs(r["score"] - none) < 1e-12 and r["clauses"] == []
    assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 6 for r in rows) == 2


def test_lexicon_has_every_entry_over_the_limits(spark):
    rows = [(i, f"aaa bbb {'vile' if i % 4 == 0 else 'mild'} ccc", int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(model["weights"]) == {"vile"}


# language identification


def test_language_edges(spark, odd):
    rows = [(i, "der und nicht schaft keit ung " * 9 if i % 2 else "the with and that ing ous " * 9, "de" if i % 2 else "en") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = [r.asDict() for r in language_id.identify(odd, model).collect()]
    assert len(got) == odd.count() and {r["Predicted"] for r in got} == {"p"}
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))][:3] == ["und"] * 3
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (4, 5)}) == 1


def test_scripts_exclude_and_many_languages_fit():
    k = 300
    model = {"langs": [f"l{i:03d}" for i in range(k)], "scores": np.full((language_id.BUCKETS, k), -5.0, np.float32), "scripts": np.zeros(k, np.uint32)}
    latin, cyrillic = (np.uint32(1 << language_id._NAMES.index(s)) for s in ("Latin", "Cyrillic"))
    model["scripts"][:] = latin
    model["scripts"][250] = cyrillic
    model["scores"][:, 250] = -4.9  # likelier everywhere, but for its script
    model["scores"][:, 200] = -4.95
    label = language_id.Labeller(model)
    assert set(label(["plain latin words " * 50])[0][2].tolist()) == {200} and set(label(["слова"])[0][2].tolist()) == {250}
    assert set(label(["w" * 5000])[0][2].tolist()) == {200}


# personal data


def test_long_values_are_permuted_whole():
    k = pii.derived_key("k")
    for n in (1, 2, 50, 220, 250, 5000):
        mail = "a" * n + "@host.example.com"
        new, found = pii.replace(f"to {mail} now", k)
        same = sum(x == y for x, y in zip(mail, found[0][3]))
        assert len(found) == 1 and len(new) == len(mail) + 7 and new.endswith(".com now")
        # letters stay by chance only
        assert n < 50 or same < 0.1 * n + 12
        assert pii.replace(f"{mail} again", k)[1][0][3] == found[0][3]


def test_permutations_are_bijections():
    k = pii.derived_key("k")
    for size in (2, 3, 97, 1000):
        assert sorted(pii.feistel(i, size, k, b"t") for i in range(size)) == list(range(size))
    for radices in ([10], [3, 10], [26, 2, 5]):
        every = list(itertools.product(*map(range, radices)))
        assert sorted(tuple(pii.permuted_symbols(list(x), radices, k, b"t")) for x in every) == every
    # wide values differ in all parts: no half of a number stays
    size = 10**60
    a, b = (pii.feistel(x, size, k, b"t") for x in (10**59, 10**59 + 1))
    assert sum(x == y for x, y in zip(f"{a:060d}", f"{b:060d}")) < 25 and a != 10**59


def test_only_valid_values_are_replaced():
    k = pii.derived_key("k")
    for text, kinds in {
        "4111 1111 1111 1111": ["card"], "4111 1111 1111 1112": [], "AB12 4111 1111 1111 1111": ["card"], "9999 4111 1111 1111 1111": ["card"],
        "30.02.2024": [], "29.02.2024": ["date"], "300.1.1.1": [], "000-12-3456": [], "GB00 WEST 1234 5698 7654 32": [],
    }.items():
        new, found = pii.replace(f"x {text} y", k)
        assert [f[0] for f in found] == kinds, text
        if found:
            _, a, b, value = found[0]
            assert new == f"x {text} y"[:a] + value + f"x {text} y"[b:]
            assert found[0][0] != "card" or pii.luhn_digit(pii._only(value)[:-1]) == value[-1]


def test_numbers_side_by_side():
    k = pii.derived_key("k")
    new, found = pii.replace("tel +1 212 555 0123 4111 1111 1111 1111", k)
    assert [f[:3] for f in found] == [("phone", 4, 19), ("card", 20, 39)] and new.startswith("tel +1 ") and "1111" not in new
    for code in ("+49 30 123456", "+1 212 555 0123", "+7 495 123 45 67", "+351 21 123 4567"):
        new = pii.replace(code, k)[0]
        assert new != code and new.split()[0] == code.split()[0]
    assert [f[0] for f in pii.replace("+4111 1111 1111 1111", k)[1]] == ["card"]
    assert [f[0] for f in pii.replace("555 123 4111 1111 1111 1111", k)[1]] == ["card"]


def test_spans_equal_the_plain_search(spark, sf):
    k, r = pii.derived_key("k"), np.random.default_rng(11)
    values = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "GB82 WEST 1234 5698 7654 32", "ES9121000418450200051332", "BE68 5390 0754 7034", "123-45-6789", "10.20.30.40", "256.1.1.1"]
    values += ["2024-02-29", "31.12.1999", "30/02/2001", "+1 212 555 0123", "+49 30 123456", "(212) 555-0199", "212.555.0199", "a.b9@x.co.uk", "x@y", "AB12", "EUR", "4111", "0123", "+", "-", "word", "666-12-3456"]
    texts = ["".join(v + s for v, s in zip(r.choice(values, 12), r.choice([" ", " ", " ", "", ", ", "\n", "-", "."], 12))) for _ in range(1500)]
    texts += [row.text for row in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if row.text]
    for t in texts:
        new, found = pii.replace(t, k)
        assert [f[:3] for f in found] == plain_pii.spans(t), t[:200]
        assert new == plain_pii.replaced(t, k)


def test_pseudonymise_edges(odd):
    rows = odd.drop("pii")
    got = [r.asDict() for r in pii.pseudonymise(rows, "k").collect()]
    phones = {r["text"] for r in got if r["doc_id"] == 6}
    assert len(got) == odd.count() and len(phones) == 1 and "555-7713" not in phones.pop()
    assert {r["score"] for r in got if r["doc_id"] is not None} == {1.5 + i for i in range(8)}


# near-duplicates


def _groups(texts: dict, k: int) -> dict:
    sets = {i: near_dedup.shingle_set(near_dedup.words_of(t or ""), k) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [(i, j) for i, j in itertools.combinations(texts, 2) if sets[i] and sets[j] and near_dedup.linked(sets[i], sets[j], 80)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if {label[i], label[j]} != {low}:
                label[i] = label[j] = low
                changed = True
    return label


def test_near_duplicates_edges(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].component_id for i in range(8)] == [0, 1, 2, 3, 4, 4, 6, 7] and [by[i].n_shingles for i in range(4)] == [0, 0, 0, 1]
    assert by[None].component_id is None and not by[None].kept and not by[5].kept


def test_shingles_of_very_long_words_are_told_apart(spark):
    w = "a" + "b" * 65_535 + "c"
    text = f"{w} x {w[-1] + w[1:-1] + w[0]} x"
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), k=2).first()
    assert got.n_shingles == 3
    assert len(near_dedup.shingle_hashes(text.encode(), 2)) == 3


def _near_misses(n: int) -> dict:
    """One passage in all texts, with words of their own: 0.766 alike, no two linked."""
    return {i: " ".join([f"p{j}" for j in range(400)] + [f"{i}r{j}" for j in range(61)]) for i in range(n)}


@pytest.mark.parametrize("n", (40, 160))
def test_near_misses_meet_in_no_cell(spark, n, monkeypatch):
    seen = []
    keys = near_dedup._rare_keys

    def counted(*a):
        out = keys(*a)
        seen.append(out.count())  # its folders go with the call
        return out

    monkeypatch.setattr(near_dedup, "_rare_keys", counted)
    texts = _near_misses(n)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), k=1).collect()
    assert all(r.kept for r in got) and len(got) == n
    assert seen and sum(seen) == 0


@pytest.mark.parametrize("turns", (0, 1))
def test_long_sides_of_joins_are_not_sent_to_all_tasks(spark, turns, monkeypatch):
    """Labels, buckets and pairs grow with the rows: what is not known to be few is only shuffled."""
    plans, plain = [], near_dedup.stored

    def seen(df, name):
        df._jdf.queryExecution().toRdd().count()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(near_dedup, "stored", seen)
    monkeypatch.setattr(near_dedup, "TURNS", turns)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    texts = {i: " ".join(f"w{i % 20}-{j}" for j in range(40 + i % 3)) for i in range(80)} | {i: f"alone {i}" for i in range(80, 90)}
    out = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), k=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == _groups(texts, 2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("cell_bytes", (1 << 21, 20_000))
def test_cells_find_what_turns_leave(spark, cell_bytes, monkeypatch):
    """Without turns all links come from the cells; small cells deal clusters into blocks."""
    monkeypatch.setattr(near_dedup, "TURNS", 0)
    monkeypatch.setattr(near_dedup, "CELL_BYTES", cell_bytes)
    r = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = {}
    for group in range(6):
        base = r.choice(vocabulary, 120).tolist()
        for i in range(25):
            words = list(base)
            for j in r.choice(120, r.integers(0, 14), replace=False):
                words[j] = str(r.choice(vocabulary))
            texts[group * 1000 + i] = " ".join(words)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), k=2).collect()}
    assert got == _groups(texts, 2)


# the pipeline


def _viterbi(scores: np.ndarray) -> list[int]:
    best = [float(x) for x in scores[0]]
    back = []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: best[i])
        high = best[top] - language_id.SWITCH
        back.append([i if best[i] >= high else top for i in range(len(best))])
        best = [max(b, high) + float(s) for b, s in zip(best, row)]
    path = [max(range(len(best)), key=lambda i: best[i])]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def _language_kept(text: str | None, model: dict, usual: dict) -> bool:
    if text is None or not re.search(r"[^\W\d_]", text):
        return False
    label = language_id.Labeller(model)
    scores, starts, ends, known = label._word_scores(text)
    if not len(starts):
        return False
    path = _viterbi(scores)
    letters = [0] * len(model["langs"])
    for x, a, b in zip(path, starts, ends):
        letters[x] += int(b - a)
    best = max(range(len(letters)), key=lambda i: letters[i])
    total = sum(letters)
    mean, most = usual.get(model["langs"][best], (min(m for m, _ in usual.values()), max(s for _, s in usual.values())))
    fit = sum(float(scores[i, x]) for i, x in enumerate(path)) / total
    share = sum(int(b - a) for a, b, ok in zip(starts, ends, known) if ok) / total
    return share >= 0.5 and letters[best] / total >= 0.35 and (mean - fit) * min(total, language_id.STEADY) ** 0.5 <= most


def test_pipeline_equals_brute_force(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    model = language_id.fit(documents)
    usual = language_id.usual_fit(documents, model)
    texts = {i: t for i, t in texts.items() if _language_kept(t, model, usual)}
    left = documents.filter(F.col("doc_id").isin(list(texts)))
    toxic = toxicity.fit(left, spark.read.parquet(f"{sf}/labels.parquet"))
    lexicon, grammar = toxicity.Lexicon(toxic["weights"]), toxicity.Grammar(toxic["paths"])
    texts = {i: t for i, t in texts.items() if toxicity.score_of(t, toxic, lexicon, grammar)[0] < 0.3}
    label = _groups(texts, 5)
    texts = {i: t for i, t in texts.items() if label[i] == i}
    key = pii.derived_key(PSEUDONYM_SECRET)
    texts = {i: plain_pii.replaced(t, key) for i, t in texts.items()}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        pieces.sort()
        assert {p[2] for p in pieces} == {want[i]}
        assert [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces)]))[:-1] and sum(p[1] for p in pieces) == want[i]


def test_stages_keep_columns_of_clashing_names(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = {"score": F.col("doc_id") + 0.5, "LANG_PRED": F.lit("mine"), "predicted": F.lit("own"), "clauses": F.lit(4), "pii": F.lit("p"), "lang_spans": F.lit(True)}
    docs = corpus_pipeline.stored(documents.withColumns(names), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), f"clash-{name}")
        assert docs.columns == [*documents.columns, *names]
        rows = docs.collect()
        assert rows and all((r.score, r.LANG_PRED, r.predicted, r.clauses, r.pii, r.lang_spans) == (r.doc_id + 0.5, "mine", "own", 4, "p", True) for r in rows)


def test_one_length_fills_windows(spark):
    """A third and more of all pieces of one length."""
    docs = spark.createDataFrame([(i, "x " * 700 if i % 2 else f"y {i}") for i in range(120)], "doc_id bigint, text string")
    rows = packing.pack(docs).collect()
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)]))[:-1] and sum(n for _, n in parts) <= 1024


def test_scratch_folders_go_but_for_what_results_read(spark):
    import os

    from trackloom.llm.common import scratch, shared_dir, stored

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    df = spark.createDataFrame([(i, f"a b {i % 3}") for i in range(9)], "doc_id bigint, text string")
    out = near_dedup.near_duplicates(df)
    names = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before if not x.startswith(".")}
    assert names <= {"dedup-docs", "dedup-classes", "dedup-labels"} and out.count() == 9 and out.filter("kept").count() == 3
    with scratch(spark) as keep:
        kept = stored(df, "kept")
        gone = stored(df, "gone")
        keep(kept)
    assert kept.count() == 9 and gone is not kept
    assert not [x for x in os.listdir(root) if x.startswith("gone-")]


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from trackloom.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


@pytest.mark.parametrize("k", (1, 2, 5))
def test_numbered_sets_stand_for_the_shingles(k):
    r = np.random.default_rng(k)
    words = [" ".join(r.choice(["a", "b", "c", "é"], int(r.integers(1, 12)))) for _ in range(60)]
    got, total = near_dedup.numbered_sets(words, k)
    sets = [near_dedup.shingle_set(w.encode().split(b" "), k) for w in words]
    assert max(int(x.max()) for x in got) < total
    for i, j in itertools.combinations(range(60), 2):
        assert len(got[i]) == len(sets[i]) and len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j])


def test_usual_fit_reads_all_held_out_rows(spark):
    docs = spark.range(16_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('word ', translate(hex(id), '0123456789', 'ghijklmnop')) AS text").repartition(4)
    model = language_id.fit(docs)
    held = language_id.identify(docs.filter(~language_id.in_training()), model)
    mean = held.selectExpr("sum(lang_fit * lang_letters) / sum(lang_letters)").first()[0]
    assert abs(language_id.usual_fit(docs, model)["en"][0] - mean) < 1e-9
