"""Language identification with spans of mixed-language text.

Letter trigrams of labelled texts give each language a score per word. A word's script (by its
characters' ranges) narrows the candidates to languages that use it; Viterbi over the words' scores,
with a penalty for switching, labels spans; a document's language is the one with most letters.
All steps work on whole batches of bytes with numpy, inside the tasks that hold the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import fold_batches, map_batches, text_of

#: Trigram buckets of the model.
BUCKETS = 1 << 16
#: Labelled rows of a language that are learned from, about; the documented bound of the sample.
SAMPLE_ROWS = 3000
#: Cost of a change of language between two words, as a log-likelihood.
SWITCH = 6.0
#: Letters from which on a text's mean log-likelihood is taken to vary no less; times the 99th
#: percentile of held-out rows' shortfall beyond which a text is in no known language.
STEADY, SHORTFALL = 200, 3.0
#: Bytes of text whose scores are computed at once.
BLOCK = 2 << 20

#: Scripts by first code point of their ranges, up to the next row's.
SCRIPTS = (
    (0x0000, None), (0x0041, "Latin"), (0x005B, None), (0x0061, "Latin"), (0x007B, None), (0x00AA, "Latin"), (0x00AB, None), (0x00BA, "Latin"), (0x00BB, None),
    (0x00C0, "Latin"), (0x0250, None), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, None),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, None), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, None), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, None), (0x3040, "Kana"), (0x3100, None), (0x3400, "Han"), (0xA000, None), (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, None), (0x20000, "Han"), (0x32000, None),
)
_NAMES = sorted({s for _, s in SCRIPTS if s})
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_BITS = np.array([0 if s is None else 1 << _NAMES.index(s) for _, s in SCRIPTS], np.uint32)
_LOWER = np.arange(0x3000, dtype=np.uint32)
for _i in range(0x3000):
    _l = chr(_i).lower()
    if len(_l) == 1:
        _LOWER[_i] = ord(_l)
del _i, _l


def in_training(key: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(4)) != 2, F.lit(True))


def _codes(text: str) -> np.ndarray:
    """Code points in lower case."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(x < len(_LOWER), _LOWER[np.minimum(x, len(_LOWER) - 1)], x)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of code points: starts and ends of runs of letters, each run's script bits, each place's trigram bucket."""
    bits = _BITS[np.searchsorted(_STARTS, codes, "right") - 1]
    letter = np.concatenate([[False], bits > 0, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    x = np.where(bits > 0, codes, 32).astype(np.uint32)
    before, after = np.concatenate([[32], x[:-1]]).astype(np.uint32), np.concatenate([x[1:], [32]]).astype(np.uint32)
    h = (before * np.uint32(0x9E3779B1)) ^ (x * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return starts, ends, np.bitwise_or.reduceat(bits, starts) if len(starts) else bits[:0], (h * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model of labelled rows: languages, log-likelihoods (bucket, language) and each
    language's scripts. Of a language with more than ``sample_rows`` rows, about as many are taken
    by a hash of the key; the counts are made in tasks, and only the model comes to the driver."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & in_training(key))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "scores": np.zeros((BUCKETS, 0), np.float32), "scripts": np.zeros(0, np.uint32)}
    share = F.create_map(*(F.lit(v) for la in langs for v in (la, min(1.0, sample_rows / sizes[la]))))
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.filter(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), text_of(text).alias("text")).repartition(8)

    def make():
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(b):
            for la, t in zip(b["lang"], b["text"]):
                counts, scripts = found.setdefault(la, (np.zeros(BUCKETS, np.int64), np.zeros(32, np.int64)))
                codes = _codes(t)
                starts, ends, bits, h = _words(codes)
                inside = np.repeat(np.arange(len(starts)), ends - starts)
                places = np.arange(len(inside)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + starts[inside]
                np.add.at(counts, h[places], 1)
                for i in range(32):
                    scripts[i] += int(((bits >> np.uint32(i)) & 1).sum())

        return add, lambda: {"lang": list(found), "counts": [c.tobytes() for c, _ in found.values()], "scripts": [s.tobytes() for _, s in found.values()]}

    # one row a language and task of the bounded sample
    parts = fold_batches(sample, make, "lang string, counts binary, scripts binary").collect()
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((32, len(langs)))
    for r in parts:
        counts[:, langs.index(r[0])] += np.frombuffer(r[1], np.int64)
        scripts[:, langs.index(r[0])] += np.frombuffer(r[2], np.int64)
    used = (counts.sum(1) > 0).sum() + 1
    scores = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * used))
    share_of = scripts / np.maximum(scripts.sum(0), 1)
    bits = np.array([sum(1 << i for i in range(32) if share_of[i, j] >= 0.01) for j in range(len(langs))], np.uint32)
    return {"langs": langs, "scores": scores.astype(np.float32), "scripts": bits}


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for documents of ``lengths`` words whose scores (word,
    language) follow each other: all documents advance together, longest first."""
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    best = np.zeros((len(size), k), np.float32)
    stay, jump = np.zeros((n, k), bool), np.zeros(n, np.int32)
    for t, m in enumerate(alive):
        at = first[:m] + t
        top = best[:m].argmax(1)
        high = best[np.arange(m), top] - switch
        keep = best[:m] >= high[:, None]
        stay[at], jump[at] = keep, top
        best[:m] = np.where(keep, best[:m], high[:, None]) + scores[at]
    out = np.zeros(n, np.int32)
    state = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = first[:m] + t
        out[at] = state[:m]
        state[:m] = np.where(stay[at, state[:m]], state[:m], jump[at])
    return out


class Labeller:
    """Word labels and document languages of a batch of texts under a model."""

    def __init__(self, model: dict, switch: float = SWITCH):
        self.langs, self.scores, self.switch = model["langs"], model["scores"], switch
        self.scripts = model["scripts"]

    def _word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes = _codes(text)
        starts, ends, bits, h = _words(codes)
        k = len(self.langs)
        out = np.empty((len(starts), k), np.float32)
        step = max(1, BLOCK // 4)
        i = 0
        while i < len(starts):  # blocks bound the memory of very long texts
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
            part = self.scores[h[starts[i] : ends[j - 1]]]
            sums = np.zeros((len(part) + 1, k), np.float64)
            np.cumsum(part, 0, out=sums[1:])
            out[i:j] = sums[ends[i:j] - starts[i]] - sums[starts[i:j] - starts[i]]
            i = j
        # languages that use a script of the word; all of them where none does
        allowed = (bits[:, None] & self.scripts) > 0
        out[~allowed & allowed.any(1)[:, None]] = -np.inf
        return out, starts, ends, allowed.any(1)

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[int], np.ndarray]]:
        """For each text: starts, ends and languages (indices) of its words."""
        return [x[:3] for x in self.judged(texts)]

    def judged(self, texts: list[str]) -> list[tuple]:
        """For each text: starts, ends and languages of its words, the sum of its trigrams'
        log-likelihoods under these, and the share of letters in words of a learned script."""
        found = [self._word_scores(t) for t in texts]
        lengths = np.array([len(f[1]) for f in found], np.int64)
        flat = np.concatenate([f[0] for f in found]) if found else np.zeros((0, len(self.langs)), np.float32)
        labels = viterbi(flat, lengths, self.switch) if len(flat) else np.zeros(0, np.int32)
        out = []
        for f, part in zip(found, np.split(labels, np.cumsum(lengths)[:-1])):
            size = f[2] - f[1]
            out.append((f[1], f[2], part, float(f[0][np.arange(len(part)), part].sum()), float(size[f[3]].sum() / max(1, size.sum()))))
        return out


def spans(starts, ends, labels) -> list[tuple[int, int, int]]:
    """Runs of words of one language: (start, end, language)."""
    if not len(labels):
        return []
    cut = np.flatnonzero(np.diff(labels)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]])
    return [(int(starts[i]), int(ends[j - 1]), int(labels[i])) for i, j in zip(a, b)]


def identify(docs: DataFrame, model: dict, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score (share of letters whose word has that language), lang_spans
    (array of start, end, lang in code points), lang_letters (letters of listed scripts), lang_fit
    (mean log-likelihood of their trigrams) and lang_known (share of them in words of a script that
    a learned language uses).

    Null texts and texts without a letter are ``und`` with score 0 and no spans; so is everything
    under a model without languages. Ties go to the language first in order. Columns of these names
    are replaced, all others stay. Equal texts have equal results; rows are independent, there is no
    shuffle. A text in a script that no language uses is scored by its trigrams alone.
    """
    rows = docs.drop("lang_pred", "score", "lang_spans", "lang_letters", "lang_fit", "lang_known")
    rows = rows.withColumn("__letters", F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__letters")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        label = Labeller(shared.value, switch)
        langs = label.langs

        def work(b):
            letters, texts = b.pop("__letters"), b[text]
            n = len(texts)
            pred, score, parts = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            letter_counts, fits, known = [0] * n, [0.0] * n, [0.0] * n
            at = [i for i in range(n) if letters[i] and langs]
            i = 0
            while i < len(at):  # as many texts at once as make a block
                j, size = i, 0
                while j < len(at) and (j == i or size + len(texts[at[j]]) <= BLOCK):
                    size += len(texts[at[j]])
                    j += 1
                for row, (starts, ends, labels, total, share) in zip(at[i:j], label.judged([texts[x] for x in at[i:j]])):
                    if len(labels):
                        letter_counts[row] = int((ends - starts).sum())
                        fits[row], known[row] = total / letter_counts[row], share
                        letters_of = np.bincount(labels, ends - starts, minlength=len(langs))
                        best = int(letters_of.argmax())
                        pred[row], score[row] = langs[best], float(letters_of[best] / letters_of.sum())
                        parts[row] = [{"start": s, "end": e, "lang": langs[x]} for s, e, x in spans(starts, ends, labels)]
                    else:  # letters of no listed script
                        pred[row], score[row] = langs[0], 1.0 / len(langs)
                i = j
            return b | {"lang_pred": pred, "score": score, "lang_spans": parts, "lang_letters": letter_counts, "lang_fit": fits, "lang_known": known}

        return work

    return map_batches(rows, make, f"{schema}, lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>, lang_letters int, lang_fit double, lang_known double")


def usual_fit(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """For each language found in held-out labelled rows, all of which are read: the mean
    log-likelihood of a letter's trigram, and the largest shortfall of a text, which is the loosest of
    all languages'."""
    held = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~in_training(key))
    if not model["langs"]:
        return {}
    # no column of the texts: three values a row
    rows = identify(held.select(F.col(text).alias("text")), model).filter("lang_letters > 0").select("lang_pred", "lang_letters", "lang_fit").persist()
    means = {r[0]: float(r[1]) for r in rows.groupBy("lang_pred").agg(F.sum(F.col("lang_fit") * F.col("lang_letters")) / F.sum("lang_letters")).collect()}
    out = {}
    if means:
        mean = F.create_map(*(F.lit(v) for x in means.items() for v in x))[F.col("lang_pred")]
        for r in rows.groupBy("lang_pred").agg(F.percentile_approx(shortfall(mean), 0.99, 10_000)).collect():
            out[r[0]] = means[r[0]], SHORTFALL * max(1.0, float(r[1]))
    rows.unpersist()
    loosest = max((x for _, x in out.values()), default=0.0)  # a language with few rows shows little of its range
    return {la: (m, loosest) for la, (m, _) in out.items()}


def shortfall(mean: Column) -> Column:
    """How far a text's mean log-likelihood lies under ``mean``, in units that its length allows."""
    return (mean - F.col("lang_fit")) * F.sqrt(F.least(F.col("lang_letters"), F.lit(STEADY)))


def in_known_language(usual: dict[str, tuple[float, float]]) -> Column:
    """Of rows of identify(): at least half the letters are in scripts of learned languages, and the
    trigrams are as likely as in held-out rows of the language. A language without held-out rows is
    held against the loosest of the others; without any, the scripts alone decide."""
    known = (F.col("lang_pred") != "und") & (F.col("lang_known") >= 0.5)
    if not usual:
        return known
    loosest = min(m for m, _ in usual.values()), max(s for _, s in usual.values())
    of = lambda i: F.coalesce(F.create_map(*(F.lit(v) for la, x in usual.items() for v in (la, x[i])))[F.col("lang_pred")], F.lit(loosest[i]))
    return known & (shortfall(of(0)) <= of(1))
