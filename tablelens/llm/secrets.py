"""Secret scans with character Markov models (operator 9).

DataFrame functions only. Three base rules find what looks like a secret by
its form. Two first-order Markov models over the characters of identifiers,
one of random strings and one of ordinary identifiers, find more: of every run
of RUN or more such characters with a letter and a digit the log-likelihood
ratio is summed, and a run whose ratio is above that of the prior odds is a
span of kind `markov`; for short runs the odds must be higher.
Of a run that a base span overlaps the parts outside are judged each for itself.

Training samples. Ordinary: the runs of four and more characters, without
what the base rules find, of about TRAIN_ROWS documents, chosen by a hash. Random: as many strings of the alphabets that keys are written in,
made from hash digests. Only counts of character pairs (67 x 67) reach the
driver; they become a table of ratios.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.
They come from the lengths of the matches and of what stands between them, in
the row itself: no shuffle. Null texts count as empty and have no spans; rows
that repeat get the same result; an empty table gives an empty result (its
ordinary model is then uniform).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, quoted, text_or_empty

# The base rules and the least length of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more is a whole run of [0-9a-f]+
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE, LEAST_ACCESS = 8, 16

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
LETTERS = "A-Za-z0-9+/_=.-"
#: Shortest run that the models judge.
RUN = 12
#: Whole runs with a digit and a letter; a run is looked at from its first character only.
RUNS = f"(?<![{LETTERS}])(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z])[{LETTERS}]{{{RUN},}}+"
#: Documents whose identifiers train the ordinary model, about, and random strings.
TRAIN_ROWS, RANDOM = 2000, 20_000
#: A run is a secret if random is this many times likelier, and e to the power of
#: SHORT times for each character that it is shorter than PLAIN: ordinary runs are the more the shorter.
ODDS, PLAIN, SHORT = 1e6, 20, 0.5

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _spans(t: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches for which keep(match, number from 0) holds."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(t, p, F.lit(0))
    between = F.split(t, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        gap = F.char_length(F.get(between_, i))
        match = F.get(found_, i)
        first = acc["at"] + gap
        stop = first + F.char_length(match)
        one = F.array(F.struct(first.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(keep(match, i), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    both = F.array(F.struct(found.alias("f"), between.alias("b")))
    found_ = between_ = None

    def whole(x: Column) -> Column:
        nonlocal found_, between_
        found_, between_ = x["f"], x["b"]
        return F.aggregate(F.sequence(F.lit(0), F.size(x["f"]) - 1), start, step)["out"]

    some = F.element_at(F.transform(both, whole), 1)
    return F.when(t.rlike(pattern), some).otherwise(F.array().cast(SPAN))


def base_spans(t: Column) -> list[Column]:
    """Spans of the three base rules."""
    return [
        # A match's last group is what is left of it without the name, the sign and the quote before the value.
        _spans(t, ASSIGN, 0, lambda m, i: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE),
        _spans(t, ACCESS, 1, lambda m, i: F.char_length(m) >= LEAST_ACCESS),
        _spans(t, HEX, 2, lambda m, i: F.lit(True)),
    ]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> list[float]:
    """The log-likelihood ratio of every pair of characters (row: first one)."""
    t = text_or_empty(text)
    chance = min(1.0, rows / max(1, docs.count()))
    sample = docs.filter(F.pmod(F.xxhash64(F.col(quoted(key)), t), F.lit(1 << 30)) / (1 << 30) < chance).select(t.alias("t"))
    clean = F.col("t")
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, pattern, " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(clean, F.lit(f"[{LETTERS}]{{4,}}"), F.lit(0))).alias("s"), F.lit(0).alias("kind"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.translate(F.base64(F.unhex(digest)), "=", "")
    made = F.element_at(F.array(code, digest, F.translate(code, "+/", "_-"), F.upper(F.translate(code, "+/", "")), F.translate(code, "+/", "")), (F.col("id") % 5 + 1).cast("int"))
    random = docs.sparkSession.range(RANDOM).select(made.alias("s"), F.lit(1).alias("kind"))
    pairs = ordinary.union(random).select("kind", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))).alias("p"))
    size = len(ALPHABET)
    seen = [[0] * (size * size), [0] * (size * size)]
    for r in pairs.groupBy("kind", "p").agg(F.count("*").alias("n")).collect():  # at most 2 x 67 x 67 rows
        seen[r["kind"]][ALPHABET.index(r["p"][0]) * size + ALPHABET.index(r["p"][1])] = r["n"]
    out = []
    for a in range(size):
        part = [counts[a * size : (a + 1) * size] for counts in seen]
        total = [sum(x) + 0.5 * size for x in part]
        out += [round(math.log((part[1][b] + 0.5) / total[1]) - math.log((part[0][b] + 0.5) / total[0]), 6) for b in range(size)]
    return out


def ratio(s: Column, table: Column) -> Column:
    """The summed log-likelihood ratio of a run."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.element_at(
        F.transform(
            F.array(codes),
            lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(c, i - 1) * len(ALPHABET) + F.get(c, i))),
        ),
        1,
    )


def markov_spans(t: Column, table: list[float], base: Column, odds: float = ODDS) -> Column:
    """Spans that the models take for random: runs, and what base spans leave of runs."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    none = F.array().cast(SPAN)

    def secret(m: Column) -> Column:
        least = math.log(odds) + SHORT * F.greatest(F.lit(0), F.lit(PLAIN) - F.char_length(m))
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (ratio(m, ratios) >= least)

    def overlap(b: Column, m: Column) -> Column:
        return (b["start"] < m["stop"]) & (m["start"] < b["stop"])

    def parts(run: Column) -> Column:
        def cut(acc: Column, b: Column) -> Column:
            one = F.array(F.struct(acc["at"].alias("start"), F.lit(3).alias("kind"), b["start"].alias("stop")))
            return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        start = F.struct(run["start"].alias("at"), none.alias("out"))
        last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.lit(3).alias("kind"), run["stop"].alias("stop"))))
        return F.aggregate(F.array_sort(F.filter(base, lambda b: overlap(b, run))), start, cut, last)

    whole = F.when(F.exists(F.regexp_extract_all(t, F.lit(RUNS), F.lit(0)), secret), _spans(t, RUNS, 3, lambda m, i: secret(m))).otherwise(none)
    whole = F.filter(whole, lambda m: ~F.exists(base, lambda b: overlap(b, m)))
    touched = F.filter(_spans(t, RUNS, 3, lambda m, i: F.lit(True)), lambda m: F.exists(base, lambda b: overlap(b, m)))
    long_ = lambda m: (m["stop"] - m["start"] >= RUN) & secret(F.substr(t, m["start"] + 1, m["stop"] - m["start"]))
    left = F.when(F.size(base) > 0, F.filter(F.flatten(F.transform(touched, parts)), long_)).otherwise(none)
    return F.concat(whole, left)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", table: list[float] | None = None) -> tuple[DataFrame, list[str]]:
    """docs with a column of spans (start, kind, stop) for each kind, and the columns' names."""
    table = train(docs, key, text) if table is None else table
    names = fresh(docs, "assign", "access", "hex", "markov")
    out = docs.withColumns(dict(zip(names, base_spans(text_or_empty(text)))))
    return out.withColumn(names[3], markov_spans(text_or_empty(text), table, F.concat(*names[:3]))), names


def as_text(spans: Column) -> Column:
    """kind:start:stop by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of every document."""
    rows = docs.select(named(docs, key).alias("k"), named(docs, text).alias("t"))
    found, (assign, access, hex_, markov) = scan(rows, "t", "k")
    base = F.concat(assign, access, hex_)
    return found.select(
        F.col("k").alias(key),
        F.size(assign).cast("long").alias("n_assign"),
        F.size(access).cast("long").alias("n_access"),
        F.size(hex_).cast("long").alias("n_hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.concat(base, markov)).alias("spans"),
        F.size(markov).cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """docs with every span (those that overlap together) replaced by `mark`."""
    seen, names = scan(docs, text, key, table)
    found = F.array_sort(F.concat(*names))
    t = F.col(quoted(text))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(apart, gap).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.greatest(F.char_length(t) - acc["at"], F.lit(0))))

    clean = F.when(F.size(found) > 0, F.aggregate(found, start, step, end)).otherwise(t)
    return seen.select(*[(clean if c == text else F.col(quoted(c))).alias(c) for c in docs.columns])
