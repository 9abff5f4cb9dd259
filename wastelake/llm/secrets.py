r"""Secret scan with expressions only: fixed patterns plus sliding-window entropy.

Patterns give base spans. The entropy method looks at candidate strings (runs of token characters),
slides a window over each and keeps the window's character counts from step to step: one count goes
up, one goes down, and the entropy sum changes by two table look-ups. Each character class has its own
window and threshold. An allow list drops candidates that look like secrets and are not.

There is no shuffle: every document is judged where it is read, whatever its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.llm.common import whole_text

# Kinds in the order that breaks ties, with their pattern and what a match must hold.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_CHARS = 20
HEX = r"[0-9a-f]+"
HEX_CHARS = 24
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class: what a run must hold, window length and least bits a character."""

    name: str
    candidate: str
    holds: tuple[str, ...]
    window: int
    bits: float
    short_bits: float | None = None

    def least(self, length: Column) -> Column:
        """Bits asked of a candidate; one no longer than the window has a single window to show them."""
        return F.lit(self.bits) if self.short_bits is None else F.when(length <= self.window, self.short_bits).otherwise(self.bits)


#: Mixed tokens need a digit and letters of both cases: long plain words are not candidates. Tokens of one case need digits on
#: both sides of a letter and a letter that is no hex digit. The bits let 99 of 100 random tokens pass (20 to 32
#: characters of 62, 36 or 32 signs).
CLASSES = (
    CharClass("hex_entropy", r"(?<![0-9A-Za-z+/_=-])[0-9a-fA-F]{32,}(?![0-9A-Za-z+/_=-])", ("[0-9]", "[a-fA-F]"), 32, 3.0),
    CharClass("token_entropy", r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{20,}(?![0-9A-Za-z+/_=-])", ("[0-9]", "[a-z]", "[A-Z]"), 20, 3.8, 3.6),
    CharClass("cased_entropy", r"(?<![0-9A-Za-z+/_=-])(?:[0-9a-z]{20,}|[0-9A-Z]{20,})(?![0-9A-Za-z+/_=-])", ("[0-9][A-Za-z]+[0-9]", "[g-zG-Z]"), 20, 3.45, 3.35),
)
#: Candidates that are no secrets: documentation samples, paths, identifiers joined by dashes.
ALLOW = (r"(?i)example", r"(?i)^(?:sha(?:256|512)|md5)[-=]", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(?:/?[A-Za-z][a-z]*)(?:[/_-][A-Za-z]?[a-z]*)+$")


#: Matches whose lengths are summed in one step; a text of m matches takes about m * RUN additions.
RUN = 64


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value worked out once; inside a lambda each mention would be a new evaluation."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves tell every position by running lengths: sums of runs of
    matches first, then within each run, so that no step copies what all steps before it found.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.struct(hits.alias("hits"), F.zip_with(gaps, hits, lambda g, h: g + F.length(h)).alias("steps"))  # the last gap has no match: null
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def headed(v: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(v["hits"]) - 1) / RUN).cast("int"))
        sums = F.transform(runs, lambda k: total(F.slice(v["steps"], k * RUN + 1, F.least(F.lit(RUN), F.size(v["hits"]) - k * RUN))))
        heads = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"],
        )
        return _let(F.struct(v["hits"].alias("hits"), v["steps"].alias("steps"), heads.alias("heads")), placed)

    def placed(v: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            end = F.get(v["heads"], run) + total(F.slice(v["steps"], run * RUN + 1, i - run * RUN + 1))
            return _let(end, lambda e: F.struct((e - F.length(hit)).alias("start"), e.alias("end"), hit.alias("hit")))

        return F.transform(v["hits"], span)

    return F.when(text.rlike(pattern), _let(found, headed)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))


def _kind(spans: Column, kind: str, rank: int, keep=None) -> Column:
    """array<struct<start, rank, kind, end>> of the spans that hold."""
    kept = spans if keep is None else F.filter(spans, keep)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of every base kind. A run is maximal, so asking its length in the pattern keeps the same matches."""
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGN_VALUE
    return {
        "assign": _kind(_spans(text, ASSIGN), "assign", 0, value),
        "access": _kind(_spans(text, ACCESS[:-1] + f"{{{ACCESS_CHARS - 4},}}"), "access", 1),
        "hex": _kind(_spans(text, HEX[:-1] + f"{{{HEX_CHARS},}}"), "hex", 2),
    }


def best_entropy(text: Column, window: int) -> Column:
    """Bits a character of the richest window of the string; the whole string where it is shorter."""
    chars = F.split(text, "")
    width = F.least(F.length(text), F.lit(window))
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 1)])
    none = F.map_from_arrays(F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<int>)"))

    def count(m: Column, c: Column) -> Column:
        return F.coalesce(F.try_element_at(m, c), F.lit(0))

    def put(m: Column, c: Column, n: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, _: k != c), F.create_map(c, n))

    def enter(s: Column, c: Column) -> Column:
        n = count(s["counts"], c)
        return F.struct(put(s["counts"], c, n + 1).alias("counts"), (s["sum"] + F.get(table, n + 1) - F.get(table, n)).alias("sum"), s["best"].alias("best"))

    def leave(s: Column, c: Column) -> Column:
        n = count(s["counts"], c)
        return F.struct(put(s["counts"], c, n - 1).alias("counts"), (s["sum"] + F.get(table, n - 1) - F.get(table, n)).alias("sum"), s["best"].alias("best"))

    def best(s: Column) -> Column:
        """The entropy of a full window is log2 w minus the sum of c log2 c over w; the least sum is the richest."""
        return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.least(s["best"], s["sum"]).alias("best"))

    first = F.aggregate(F.slice(chars, 1, width), F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best")), enter, best)
    steps = F.arrays_zip(F.slice(chars, 1, F.size(chars) - width).alias("out"), F.slice(chars, width + 1, F.size(chars)).alias("in"))
    slid = F.aggregate(steps, first, lambda s, x: best(enter(leave(s, x["out"]), x["in"])))
    return F.log2(width) - slid["best"] / width


def entropy_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[Column]:
    """Spans of the candidates of each class whose richest window reaches the class's bits."""

    def secret(c: CharClass):
        def test(s: Column) -> Column:
            fits = F.lit(True)
            for pattern in c.holds:
                fits = fits & s["hit"].rlike(pattern)
            for pattern in allow:
                fits = fits & ~s["hit"].rlike(pattern)
            return F.when(fits, best_entropy(s["hit"], c.window)).otherwise(0.0) >= c.least(F.length(s["hit"]))

        return test

    return [_kind(_spans(text, c.candidate), c.name, rank, secret(c)) for rank, c in enumerate(classes, len(BASE_KINDS))]


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, assign, access, hex, entropy: arrays of spans (start, rank, kind, end) for every row.

    Positions count code points, the end is exclusive. Null and empty texts have no spans; repeated rows
    repeat; other columns are not read; an empty table gives no rows. Allow-listed candidates lose their
    entropy span only, never a base span.
    """
    t = F.col("_text")
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text"))
    return rows.select("doc_id", *[c.alias(k) for k, c in base_spans(t).items()], F.concat(*entropy_spans(t, classes, allow)).alias("entropy"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts, the digest of the base spans, and all spans."""
    base = F.concat(*BASE_KINDS)
    return scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )
