"""Language identification by error-correcting output codes (operator 3).

Every language has a codeword of bits. For each bit a binary classifier over
hashed character n-grams tells the languages whose codewords have the bit from
the others: the mean log-odds of a text's n-grams, scaled by the square root of
their number and calibrated by logistic regression. A text's language is the
codeword of least loss, the bits' losses weighted by how well each classifier
does on the training sample; a text whose two nearest codewords are about as
near is ambiguous.

Training: about TRAIN_ROWS labelled rows a language (all if it has fewer),
chosen by a hash. Tasks count n-grams; at most languages x BUCKETS counts and
a few numbers for each row of the sample reach the driver.

A null text, or one without letters, is `und` with score 0, and so is every
text if there is nothing to learn from. Whole texts are read, however long
(in steps). Rows that repeat get the same result; nulls in key or label are
allowed (such rows don't train); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .bpe import LETTER, classes, splitmix
from .common import fresh, give_back, map_arrow, named, offsets, quoted, ship, steps

#: Rows of each language that train, about.
TRAIN_ROWS = 2000
#: Buckets of hashed n-grams, and lengths of n-grams.
BUCKETS, GRAMS = 1 << 15, (1, 2, 3)
#: Languages up to this number get an exhaustive code.
EXHAUSTIVE = 7
#: A text is ambiguous if the loss of its second codeword is less than this many times that of the first.
MARGIN = 1.1
#: Characters of a step.
STEP = 250_000
#: N-grams beyond this number make a text no surer.
SURE = 400
UND = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits) of -1, 1
    odds: np.ndarray  # (BUCKETS, bits) log-odds of an n-gram
    scale: np.ndarray  # calibration: (bits,) each
    shift: np.ndarray
    weight: np.ndarray


def codewords(n: int) -> np.ndarray:
    """(n, bits): exhaustive for few languages, else the best of some random codes."""
    if n <= EXHAUSTIVE:
        bits = max(1, 2 ** (n - 1) - 1)
        cols = [[1] + [1 if (b + 1) >> k & 1 == 0 else -1 for k in range(n - 1)] for b in range(bits)]
        return np.array(cols).T[:n]
    bits = math.ceil(15 * math.log2(n))
    best, far = None, -1
    for seed in range(32):
        code = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = ((code[:, None] != code[None]).sum(axis=2) + bits * np.eye(n, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and the number of each text. What is
    not a letter is a boundary; n-grams have at least one letter."""
    lowered = [t.lower() + "  " for t in texts]
    cp = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = classes()[cp] == LETTER
    cp = np.where(letter, cp, np.uint64(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first boundary after a letter
    keep[0] = True
    edge = offsets(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    keep[edge[:-1]] = True
    at = np.flatnonzero(keep)
    cp, letter, mix = cp[at], letter[at], splitmix(max(GRAMS) + 1, 5)
    bound = np.searchsorted(at, edge)
    doc = np.repeat(np.arange(len(texts)), np.diff(bound))
    found, owner = [], []
    for n in GRAMS:
        if len(cp) < n:
            continue
        h, some = np.full(len(cp) - n + 1, mix[n]), np.zeros(len(cp) - n + 1, bool)
        for j in range(n):
            part = slice(j, len(cp) - n + 1 + j)
            h = (h ^ (cp[part] + np.uint64(1))) * mix[j]
            some |= letter[part]
        ok = some & (doc[: len(h)] == doc[n - 1 :])
        h = h[ok]
        found.append(((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(doc[: len(ok)][ok])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(texts))


def means(texts: list[str], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bits) mean log-odds and the number of n-grams; a text beyond a step in parts."""
    total, count = np.zeros((len(texts), odds.shape[1])), np.zeros(len(texts), np.int64)
    for lo, hi in steps(texts, STEP):
        parts, owner = [], []
        for i in range(lo, hi):
            for s in range(0, max(1, len(texts[i])), STEP):
                parts.append(texts[i][s : s + STEP])
                owner.append(i)
        for a, b in steps(parts, STEP):
            found, n = grams(parts[a:b])
            some = np.flatnonzero(n)
            if len(some):
                sums = np.add.reduceat(odds[found], offsets(n)[some], axis=0, dtype=np.float64)
                np.add.at(total, np.array(owner[a:b])[some], sums)
                np.add.at(count, owner[a:b], n)
    return total / np.maximum(count, 1)[:, None], count


def margins(mean: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    return mean * np.sqrt(np.minimum(count, SURE))[:, None] * model.scale + model.shift


def losses(margin: np.ndarray, model: Model) -> np.ndarray:
    """(texts, languages) weighted logistic loss of each codeword."""
    z = margin[:, None, :] * model.code[None]
    return (np.logaddexp(0, -np.clip(z, -30, 30)) * model.weight).sum(axis=2)


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each text."""
    loss = losses(margin, model)
    order = np.argsort(loss, axis=1, kind="stable")
    first = loss[np.arange(len(loss)), order[:, 0]]
    likely = np.exp(first[:, None] - loss)
    score = 1 / likely.sum(axis=1)
    if loss.shape[1] == 1:
        return order[:, 0], score, np.zeros(len(loss), bool)
    second = loss[np.arange(len(loss)), order[:, 1]]
    return order[:, 0], score, second < MARGIN * first


def remainder(key: str) -> Column:
    """crc32 of the key as text, mod 4."""
    return F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from rows with a label whose remainder is not 2."""
    labelled = docs.filter((remainder(key) != 2) & named(docs, lang).isNotNull() & named(docs, text).isNotNull())
    labelled = labelled.select(named(docs, key).alias("k"), named(docs, lang).alias("l"), named(docs, text).alias("t"))
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return None
    chance = F.element_at(F.create_map(*[x for l in names for x in (F.lit(l), F.lit(min(1.0, rows / counts[l])))]), F.col("l"))
    drawn = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) / (1 << 30) < chance
    sample = scratch_table(labelled.filter(drawn).select("l", "t"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            labels, texts = b.column("l").to_pylist(), b.column("t").to_pylist()
            for lo in range(len(texts)):
                for s in range(0, max(1, len(texts[lo])), STEP):
                    found, _ = grams([texts[lo][s : s + STEP]])
                    held = np.bincount(found, minlength=BUCKETS)
                    # a long text counts no more than a thousand n-grams
                    seen[labels[lo]] = seen.get(labels[lo], 0) + held * min(1.0, 1000 / max(1, len(found)))
        for label, held in seen.items():
            at = np.flatnonzero(held)
            yield pa.record_batch([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.float64())], ["l", "g", "n"])

    each = map_arrow(sample, count, "l string, g int, n double").groupBy("l", "g").agg(F.sum("n").alias("n"))
    table = np.zeros((len(names), BUCKETS))
    got = each.toPandas()  # at most languages x BUCKETS rows
    np.add.at(table, ([names.index(x) for x in got["l"]], got["g"].to_numpy(dtype=int)), got["n"].to_numpy(dtype=float))
    share = (table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True)
    code = codewords(len(names))
    ones, zeros = code > 0, code < 0
    odds = np.stack([np.log(share[o].mean(axis=0)) - (np.log(share[z].mean(axis=0)) if z.any() else 0) for o, z in zip(ones.T, zeros.T)], axis=1).astype(np.float32)
    bits = code.shape[1]
    model = Model(names, code, odds, np.ones(bits), np.zeros(bits), np.ones(bits) / bits)
    if len(names) == 1:
        return model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, n = means(b.column("t").to_pylist(), odds)
            z = mean * np.sqrt(np.minimum(n, SURE))[:, None]
            yield pa.record_batch([b.column("l"), pa.array(n), pa.array(list(z), pa.list_(pa.float64()))], ["l", "n", "z"])

    got = map_arrow(sample, score, "l string, n long, z array<double>").filter("n > 0").toPandas()  # the sample's rows
    if len(got):
        z, y = np.stack(got["z"]), code[[names.index(x) for x in got["l"]]]
        for b in range(bits):
            model.scale[b], model.shift[b] = calibrate(z[:, b], y[:, b])
        loss = np.logaddexp(0, -y * (z * model.scale + model.shift)).mean(axis=0)
        model.weight = 1 / (0.05 + loss)
        model.weight *= bits / model.weight.sum()
    return model


def calibrate(z: np.ndarray, y: np.ndarray, turns: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Scale and shift of ridge logistic regression by Newton's method, over standardised values."""
    centre, spread = float(z.mean()), float(z.std()) or 1.0
    x, w = np.stack([(z - centre) / spread, np.ones_like(z)], axis=1), np.zeros(2)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - (y > 0)) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def languages_of(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """(lang, score, ambiguous) of each row's text; only the text goes to Python."""
    ship(docs.sparkSession)

    def found(texts: pa.Array) -> pa.Array:
        held, out = [t or "" for t in texts.to_pylist()], ([], [], [])
        for lo, hi in steps(held, 4 * STEP):
            some = held[lo:hi]
            lang, score, unsure = [UND] * len(some), np.zeros(len(some)), np.zeros(len(some), bool)
            if model:
                mean, n = means(some, model.odds)
                best, value, vague = decode(margins(mean, n, model), model)
                lang = [model.languages[x] if c else UND for x, c in zip(best, n)]
                score, unsure = np.where(n > 0, value, 0.0), vague & (n > 0)
            for column, values in zip(out, (lang, score, unsure)):
                column.extend(values)
        kinds = (pa.string(), pa.float64(), pa.bool_())
        give_back()
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["lang", "score", "ambiguous"])

    return F.arrow_udf(found, "lang string, score double, ambiguous boolean")(named(docs, text))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score and ambiguous of every row."""
    found = languages_of(docs, fit(docs, key, text, lang), text)
    rows = docs.select(named(docs, key).alias("k"), found.alias("found"))
    out = rows.select("k", F.coalesce(remainder("k") == 2, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.ambiguous")
    return out.withColumnRenamed("k", key)


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text has a language."""
    (column,) = fresh(docs, "found")
    found = docs.withColumn(column, languages_of(docs, fit(docs, key, text, lang), text))
    return found.filter(F.col(column)["lang"] != UND).drop(column)
