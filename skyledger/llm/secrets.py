"""Secret scans: three patterns, and character Markov models that tell random strings from identifiers.

Two models of character pairs, one of random strings and one of ordinary words and identifiers, are
trained from strings that the patterns label: what the patterns find is random, the other words of the
same documents are ordinary.  A long enough string outside the patterns' finds is a secret if its
log-likelihood ratio speaks for the random model by more than the odds against a secret.

Everything is a DataFrame expression.  Java's regular expressions tell no places, so a match is put
between two marks, the text is split at the marks, and places follow from the lengths of the parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters; where a text has them, another character takes their place first.
MARK, GROUP, STAND_IN = "\ue000", "\ue001", "\ufffd"
KINDS = ("assign", "access", "hex", "random")

# The patterns.  The first one's last group must have six characters or more.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
# A match takes its whole run of characters, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

STRING = "[A-Za-z0-9+/_=-]"
LEAST = 16  # characters of a string that the models judge
WORD = 4  # characters of a string that the ordinary model learns from
SAMPLE = 20_000  # documents that models are trained on, on average
ODDS = 1e6  # strings per secret; the ratio must exceed them
SMOOTHING = 0.5  # added to the count of each pair of characters

SYMBOLS = 66  # characters that a judged string can have
FIRST, CODES = 32, 96  # characters that models know: the printable ones of ASCII
BLOCK = 128  # parts whose lengths are added up at a time

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n)


def _parts(text: Column, pattern: str, group: str = "") -> Column:
    """The text split at its matches: matches at odd places (from 0), what is between them at even ones."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{group}{MARK}"), MARK)


def _match(part: Column) -> Column:
    return F.substring_index(part, GROUP, 1)


def _spans(parts: Column, chosen: Column, kind: int) -> Column:
    """Spans of the parts at the places `chosen`.

    Lengths are added up by blocks, so that a text with very many matches takes little more than
    linear time.
    """

    def placed(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        bases = _bound(blocks, lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: _total(F.slice(sums, F.lit(1), b))))

        def span(base: Column) -> Column:
            def one(i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = F.get(base, block) + _total(F.slice(lengths, block * BLOCK + 1, i % BLOCK))
                return _bound(start, lambda s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.get(lengths, i)).alias("end")))

            return F.transform(chosen, one)

        return _bound(bases, span)

    found = _bound(F.transform(parts, lambda p: F.length(_match(p))), placed)
    return F.when(F.size(chosen) > 0, found).otherwise(F.array()).cast(SPANS)


def _odd(parts: Column, good: Callable[[Column], Column]) -> Column:
    """Places of the matches that are good."""
    places = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: good(F.get(parts, i)))


def _scan(text: Column, kind: int, pattern: str, group: str, good: Callable[[Column], Column]) -> Column:
    """`spans`, `values` (the matches, or what their last group has) and `rest`, the text with its matches blanked."""

    def found(parts: Column) -> Column:
        def result(chosen: Column) -> Column:
            value = lambda i: F.substring_index(F.get(parts, i), GROUP, -1)
            blanked = F.transform(
                parts, lambda p, i: F.when((i % 2 == 1) & good(p), F.repeat(F.lit(" "), F.length(_match(p)))).otherwise(_match(p))
            )
            return F.struct(
                _spans(parts, chosen, kind).alias("spans"),
                F.transform(chosen, value).alias("values"),
                F.array_join(blanked, "").alias("rest"),
            )

        return _bound(_odd(parts, good), result)

    none = F.struct(F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("values"), text.alias("rest"))
    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(_parts(text, pattern, group), found)).otherwise(none)


def _every(part: Column) -> Column:
    return F.lit(True)


def _base(docs: DataFrame) -> DataFrame:
    """`doc_id`, `base` (spans of the patterns), `values`, `rest` (the text without them)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK + GROUP, STAND_IN * 2)

    def scanned(t: Column) -> Column:
        long_enough = lambda p: F.length(F.substring_index(p, GROUP, -1)) >= ASSIGN_LEAST
        assign = _scan(t, 0, ASSIGN, f"{GROUP}$2", long_enough)
        access, hex_ = _scan(t, 1, ACCESS, "", _every), _scan(t, 2, HEX, "", _every)

        def joined(a: Column, c: Column, h: Column) -> Column:
            return F.struct(
                F.array_sort(F.concat(a["spans"], c["spans"], h["spans"])).alias("base"),
                F.concat(a["values"], c["values"], h["values"]).alias("values"),
                a["rest"].alias("rest"),
                (F.size(c["spans"]) + F.size(h["spans"]) > 0).alias("more"),
            )

        return _bound(assign, lambda a: _bound(access, lambda c: _bound(hex_, lambda h: joined(a, c, h))))

    # Generating one row from one keeps the optimizer from computing an expression for each of its uses.
    return docs.select("doc_id", F.inline(F.transform(F.array(text), scanned)))


def _without(text: Column, pattern: str) -> Column:
    """The text with all matches of a pattern blanked, length unchanged."""
    return _bound(
        _parts(text, pattern), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")
    )


def _rest() -> Column:
    """The text without any base span."""
    return F.when(F.col("more"), _without(_without(F.col("rest"), ACCESS), HEX)).otherwise(F.col("rest"))


def _codes(string: Column) -> Column:
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios, random against ordinary, by pair of characters."""

    table: list[float]

    def of(self, string: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.table)), ",").cast("array<double>")
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(state: Column, code: Column) -> Column:
            ratio = F.when(state["last"] < 0, F.lit(0.0)).otherwise(F.get(table, state["last"] * CODES + code))
            return F.struct(code.alias("last"), (state["sum"] + ratio).alias("sum"))

        return F.aggregate(_codes(string), start, step, lambda state: state["sum"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Ratios:
    """Both models from about `sample` documents, chosen by a hash of their ids.

    Documents without an id are not learned from.  Without any labelled string both models are even,
    and nothing is added to the patterns' finds.  The driver gets one count per pair of characters.
    """
    rows = docs.count()
    if not rows:
        return Ratios([0.0] * CODES * CODES)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets")), F.lit(1_000_000))
    chosen = docs.filter(F.col("doc_id").isNotNull() & (draw < math.ceil(1_000_000 * min(1.0, sample / rows))))
    found = _base(chosen).select("values", _rest().alias("rest"))
    words = F.regexp_extract_all("rest", F.lit(f"{STRING}{{{WORD},}}"), F.lit(0))
    labelled = found.select(
        F.inline(F.concat(F.transform("values", lambda v: F.struct(F.lit(True).alias("random"), v.alias("string"))),
                          F.transform(words, lambda w: F.struct(F.lit(False).alias("random"), w.alias("string")))))
    )
    strings = labelled.groupBy("random", "string").agg(F.count(F.lit(1)).alias("n"))
    codes = strings.select("random", "n", _codes(F.col("string")).alias("codes")).filter(F.size("codes") > 1)
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: a * CODES + b)
    counted = codes.select("random", "n", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()
    counts = {True: [0] * CODES * CODES, False: [0] * CODES * CODES}
    for row in counted:
        counts[row["random"]][row["pair"]] = row["n"]
    if not any(counts[False]):
        return Ratios([0.0] * CODES * CODES)
    likely = {label: _log_likelihoods(table) for label, table in counts.items()}
    return Ratios([r - o for r, o in zip(likely[True], likely[False])])


def _log_likelihoods(counts: list[int]) -> list[float]:
    """Of each character after each other one, with additive smoothing over the characters of a string."""
    out = []
    for first in range(CODES):
        row = counts[first * CODES : (first + 1) * CODES]
        total = sum(row) + SMOOTHING * SYMBOLS
        out += [math.log((n + SMOOTHING) / total) for n in row]
    return out


def find(docs: DataFrame, ratios: Ratios, odds: float = ODDS) -> DataFrame:
    """`doc_id`, `base`, `added`: sorted spans (`start`, `kind`, `end`) of every whole text.

    `kind` counts in `KINDS`; places are code points, ends exclusive.  `base` has what the patterns
    find, leftmost and non-overlapping per kind; `added` what the models find in the text with those
    blanked.  A null text counts as empty.  Rows are taken one by one: repeated ones come out
    repeatedly, null ids stay null.  Other columns are not looked at.
    """
    found = _base(docs).select("doc_id", "base", _rest().alias("rest"))
    judged = lambda part: ratios.of(part) > math.log(odds)
    pattern = f"{STRING}{{{LEAST},}}"
    spans = _bound(_parts(F.col("rest"), pattern), lambda parts: _bound(_odd(parts, judged), lambda chosen: _spans(parts, chosen, 3)))
    return found.select("doc_id", "base", spans.alias("added"))


def _text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
