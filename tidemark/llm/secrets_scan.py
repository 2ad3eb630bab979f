"""Secrets in documents: fixed patterns, and character Markov models for the rest.

*Patterns.* ``assign``, ``access`` and ``hex`` (below) are matched from the left without
overlap, each by itself; matches that are too short are dropped.

*Models.* Two first-order Markov chains over letters and digits are trained from labelled
samples. Random strings: what the patterns matched in the table, mixed half and half with
uniform draws, so that kinds of keys that no pattern knows are not strange to it. Ordinary
identifiers: the words of all documents that have the *form* of one (``ORDINARY``: words, camel
case, capitals, numbers, each with a few digits behind at most). What could be a key has not,
so leaked keys, however many, do not teach the model that they are ordinary.

*Candidates.* Runs of 8 or more token characters with a letter and a digit, a capital within,
or 20 characters and more; of a run that patterns touch, what they leave. A candidate is a
secret (kind ``random``) if its log-likelihood ratio, summed over its transitions, exceeds the
log odds of ordinary to random strings in the table plus ``CAUTION``, and ``SLOPE`` times what
labelled random strings of its length have on average: a bound that grows with the length. If
the whole run fails (a key at the end of a path), its parts between separators are judged.
UUIDs are identifiers by convention and not added.

Everything is a Spark function over whole texts; the models have at most one number for each
pair of characters, which is all that comes to the driver.

Positions are code points, ends exclusive. Defined cases: a null text is empty; without any
pattern match the random model is the uniform one; rows that repeat are rows of their own; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.session import materialise

# Fixed patterns: expression, group whose length counts, least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # a run of 32 or more is matched whole: the same as matching runs and dropping shorter
}
RANDOM = "random"

LEAST = 8
SEPARATORS = "+/_-"
_T = "[A-Za-z0-9+/_-]"
RUN = (
    f"(?<!{_T})(?={_T}{{{LEAST}}})(?=[0-9+/_-]*[A-Za-z])"
    f"(?=[A-Za-z+/_-]*[0-9]|{_T}*?[a-z][A-Z]|{_T}{{20}}){_T}+"
)
PART = f"[A-Za-z0-9]{{{LEAST},}}"
UUID = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
ORDINARY = "^(?:[A-Z]?[a-z]{1,20}(?:[A-Z][a-z]{1,20}){0,5}[0-9]{0,4}|[A-Z]{1,20}[0-9]{0,4}|[0-9]{1,16})$"

CAUTION = math.log(100)
SLOPE = 0.3

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CODES = len(ALPHABET) + 1  # other characters share the last one

# In counts of transitions: the number of strings of at least LEAST characters.
STRINGS = -1

# Matches whose widths are summed together.
CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _before(widths: Column, chunks: Column, i: Column) -> Column:
    """Sum of the widths before number ``i``: whole chunks, then the rest of its own."""
    k = F.floor(i / CHUNK).cast("int")
    return _sum(F.slice(chunks, F.lit(1), k)) + _sum(F.slice(widths, k * CHUNK + 1, i % CHUNK))


def matches(text: Column, pattern: str, group: int, least: int, kind: str, place: int) -> Column:
    """Array of (start, place, end, kind, value) of the pattern's matches that are long enough.

    The text between matches and the matches themselves alternate, which gives positions.
    """

    def spans(gaps: Column, found: Column, values: Column) -> Column:
        widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: g + f)
        n_chunks = F.floor((F.size(found) - 1) / CHUNK).cast("int")

        def with_widths(w: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), n_chunks), lambda c: _sum(F.slice(w, c * CHUNK + 1, F.lit(CHUNK))))

            def with_chunks(c: Column) -> Column:
                def span(value: Column, i: Column) -> Column:
                    start = _before(w, c, i) + F.get(gaps, i)
                    return F.struct(
                        start.alias("start"), F.lit(place).alias("place"), (start + F.get(found, i)).alias("end"),
                        F.lit(kind).alias("kind"), value.alias("value"),
                    )

                return F.transform(values, span)

            return let(chunks, with_chunks)

        return let(widths, with_widths)

    lengths = lambda a: F.transform(a, lambda s: F.char_length(s))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    located = let(
        lengths(F.split(text, pattern, -1)),
        lambda g: let(lengths(whole), lambda f: spans(g, f, values)),
    )
    enough = F.filter(located, lambda s: F.char_length(s["value"]) >= least)
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), enough).otherwise(none)


def left_over(run: Column, base: Column) -> Column:
    """Pieces of a run outside all base matches, as (start, value). ``base`` is sorted by start."""
    piece = lambda a, b: F.struct(
        a.alias("start"), F.substring(run["value"], a - run["start"] + 1, b - a).alias("value")
    )
    none = F.array().cast("array<struct<start:int,value:string>>")
    state = F.struct(none.alias("done"), run["start"].alias("at"))

    def step(s: Column, b: Column) -> Column:
        done = F.when(b["start"] > s["at"], F.array_append(s["done"], piece(s["at"], b["start"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.greatest(s["at"], b["end"]).alias("at"))

    def finish(s: Column) -> Column:
        return F.when(s["at"] < run["end"], F.array_append(s["done"], piece(s["at"], run["end"]))).otherwise(s["done"])

    touched = F.filter(base, lambda b: (run["start"] < b["end"]) & (b["start"] < run["end"]))
    return F.aggregate(touched, state, step, finish)


def found_by_pattern(docs: DataFrame) -> DataFrame:
    """doc_id, base (matches of the patterns) and pieces (start, value) of runs outside them."""
    text = F.col("text")
    base = F.concat(*[matches(text, p, g, n, kind, i) for i, (kind, (p, g, n)) in enumerate(KINDS.items())])
    runs = matches(text, RUN, 0, LEAST, RANDOM, len(KINDS))
    rows = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", F.array_sort(base).alias("base"), runs.alias("runs")
    )
    pieces = F.flatten(F.transform("runs", lambda r: left_over(r, F.col("base"))))
    fit = F.filter(pieces, lambda p: (F.char_length(p["value"]) >= LEAST) & ~F.regexp_like(p["value"], F.lit(UUID)))
    return rows.select("doc_id", "base", fit.alias("pieces"))


def codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 0; others count as one more."""
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    return F.transform(F.split(token, ""), lambda c: F.pmod(at(c), F.lit(CODES)))


def transitions(token: Column) -> Column:
    """Each pair of neighbouring characters as one number."""

    def pairs(c: Column) -> Column:
        rest = F.greatest(F.size(c) - 1, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), rest), F.slice(c, F.lit(2), rest), lambda a, b: a * CODES + b)

    return let(codes(token), pairs)


def ordinary(docs: DataFrame) -> DataFrame:
    """token, times: runs of letters and digits of all documents that have an ordinary form."""
    tokens = docs.select(F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("token")).where("token <> ''")
    each = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    return each.where(F.col("token").rlike(ORDINARY))


def counted(each: DataFrame) -> dict[int, int]:
    """How often each transition occurs in ``token, times``, and under ``STRINGS`` how many are of length.

    At most one number for each pair of characters comes to the driver.
    """
    long = F.when(F.char_length("token") >= LEAST, F.array(F.lit(STRINGS))).otherwise(F.array().cast("array<int>"))
    pairs = each.select("times", F.explode(F.concat(transitions(F.col("token")), long)).alias("pair"))
    return dict(pairs.groupBy("pair").agg(F.sum("times")).collect())


class Models(NamedTuple):
    """Log-likelihood ratio of each transition, and the bound on their sum: least, and slope by length."""

    table: list[float]
    least: float
    slope: float


def _chain(seen: dict[int, int]) -> list[list[float]]:
    """Probabilities of transitions, smoothed by how often the second character occurs at all."""
    n = CODES
    into = [sum(seen.get(a * n + b, 0) for a in range(n)) + 1 for b in range(n)]
    share = [i / sum(into) for i in into]
    out_of = [sum(seen.get(a * n + b, 0) for b in range(n)) + n for a in range(n)]
    return [[(seen.get(a * n + b, 0) + n * share[b]) / out_of[a] for b in range(n)] for a in range(n)]


def train(found: DataFrame, docs: DataFrame) -> Models:
    labelled = found.select(F.explode("base").alias("m")).select(F.col("m")["value"].alias("token"))
    random = counted(labelled.groupBy("token").agg(F.count(F.lit(1)).alias("times")))
    usual = counted(ordinary(docs))
    letters = range(len(ALPHABET))
    keys, words = _chain(random), _chain(usual)
    table = [0.0] * (CODES * CODES)  # separators tell nothing
    for a in letters:
        for b in letters:
            table[a * CODES + b] = math.log((keys[a][b] + 1 / len(ALPHABET)) / 2 / words[a][b])
    inside = [a * CODES + b for a in letters for b in letters]
    weight = {p: random.get(p, 0) + 1 for p in inside}
    usual_key = sum(w * table[p] for p, w in weight.items()) / sum(weight.values())
    odds = (usual.get(STRINGS, 0) + 1) / (random.get(STRINGS, 0) + 1)
    return Models(table, max(0.0, math.log(odds)) + CAUTION, SLOPE * max(0.0, usual_key))


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio, summed over the transitions."""
    return F.aggregate(transitions(token), F.lit(0.0), lambda s, i: s + F.get(F.lit(table), i))


def is_random(token: Column, models: Models) -> Column:
    bound = F.greatest(F.lit(models.least), F.lit(models.slope) * (F.char_length(token) - 1))
    return ratio(token, models.table) > bound


def judged(piece: Column, models: Models) -> Column:
    """Spans of a piece that are secrets: the whole of it, or else parts between separators."""
    span = lambda start, value: F.struct(
        start.alias("start"), F.lit(len(KINDS)).alias("place"), (start + F.char_length(value)).alias("end"),
        F.lit(RANDOM).alias("kind"), value.alias("value"),
    )
    parts = F.filter(matches(piece["value"], PART, 0, LEAST, RANDOM, len(KINDS)), lambda m: is_random(m["value"], models))
    return F.when(is_random(piece["value"], models), F.array(span(piece["start"], piece["value"]))).otherwise(
        F.transform(parts, lambda m: span(piece["start"] + m["start"], m["value"]))
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (start, place, end, kind, value) of every document."""
    found = materialise(found_by_pattern(docs), "matches")
    models = train(found, docs)
    added = F.flatten(F.transform("pieces", lambda p: judged(p, models)))
    return found.select("doc_id", "base", added.alias("added"))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
