"""Secret scanning: fixed patterns, and sliding-window Shannon entropy per character class. DataFrame functions only.

Patterns give the base spans, leftmost and non-overlapping for each kind: assign, access and hex.
The entropy scan adds spans of kind entropy. Its candidates are the maximal runs of the characters of
a class that are long enough and mix letters with digits; a window slides over each candidate. Counts
of the characters in the window are kept up to date: each step takes one character out and one in, so
that the window's entropy changes by two differences of c*log2(c), read from a table of whole numbers.
A candidate is a span if some window's entropy reaches the class's threshold and no allow-list pattern
matches it; windows that touch a filler, such as 'example' or a long repeat, don't count. All arithmetic is on whole numbers, so that the result doesn't depend on the order of sums.

Positions are code points, ends exclusive. Defined results: a null text is empty and has no spans.
Spans of different kinds may overlap, and equal ones of two kinds both stay. Repeated rows stay
repeated; an empty table gives an empty table; a null id stays null. Columns other than the id and the
text are ignored by the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so this finds what [0-9a-f]+ of 32 and more finds
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16


@dataclass(frozen=True)
class CharacterClass:
    """A window of `window` characters over `alphabet` is suspicious from `threshold` bits a character on."""

    name: str
    pattern: str
    alphabet: str
    window: int
    threshold: float


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharacterClass("hex", "[0-9a-fA-F]{32,}", DIGITS + "abcdefABCDEF", 32, 3.0),
    CharacterClass("base64", "[A-Za-z0-9+/_=-]{24,}", UPPER + LOWER + DIGITS + "+/_=-", 24, 3.9),
)
#: Candidates that are known not to be secrets: numbered names, identifiers in parts, paths.
ALLOWED = (
    r"^[A-Za-z]+[_-]?[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*(/[A-Za-z0-9]+){3,}/?$",
)
#: Placeholders and repeats of a fixed length; windows that touch one don't count, others of the same candidate do.
FILLERS = {r"(?i)example": 7, r"(?i)placeholder": 11, r"(?i)xxxxx": 5, r"(?i)abcdefgh": 8, r"12345678": 8, r"(.)\1{7}": 8}
SCALE = 1_000_000


def _points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), value being computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches whose places are summed up together.
_BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches: the pieces between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    none = F.array().cast(kind)

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + _points(pair["gap"])
        end = begin + _points(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def shifted(held: Column) -> Column:
        ends = F.aggregate(held, F.array(F.lit(0).cast("long")), lambda a, h: F.concat(a, F.array(F.element_at(a, -1) + h["at"])))
        moved = lambda h, by: F.transform(h["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(held, F.slice(ends, 1, F.size(held)), moved))

    # An array that grows is copied at each step, so it grows within a block of matches, and across blocks.
    block = lambda b: F.aggregate(b, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step)
    blocks = lambda pairs: F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(_BLOCK)), lambda at: block(F.slice(pairs, at, _BLOCK)))
    pairs = _let(found, lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("value")))
    return F.when(text.rlike(pattern), _let(_let(pairs, blocks), shifted)).otherwise(none)


def _tagged(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end")))


def c_log_c(count: int) -> int:
    """c * log2(c) in units of 1 / SCALE."""
    return round(count * log2(count) * SCALE) if count else 0


def least_sum(cls: CharacterClass) -> int:
    """A window's entropy is log2(w) - S / w, S being the sum of c*log2(c); it reaches the threshold while S is at most this."""
    return round((log2(cls.window) - cls.threshold) * cls.window * SCALE)


def _codes(value: Column, cls: CharacterClass) -> Column:
    """The place of each character in the alphabet, from 1; 0 within fillers. The value is cut once, so that no step walks through it."""
    for pattern, length in FILLERS.items():
        value = F.regexp_replace(value, pattern, " " * length)
    return F.transform(F.filter(F.split(value, ""), lambda x: x != ""), lambda x: F.call_function("instr", F.lit(cls.alphabet), x))


def _suspicious(value: Column, cls: CharacterClass) -> Column:
    """Whether some window of the candidate reaches the threshold, by incremental counts: a step changes two of them."""
    width, table = cls.window, F.array(*[F.lit(c_log_c(c)).cast("long") for c in range(cls.window + 1)])
    # Each character with the one that leaves the window as it comes in; -1 while the window fills.
    late = lambda codes: F.concat(F.array_repeat(F.lit(-1), width), F.slice(codes, 1, F.greatest(F.size(codes) - width, F.lit(0))))
    steps = lambda codes: F.slice(F.arrays_zip(codes.alias("into"), late(codes).alias("outof")), 1, F.size(codes))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"),
        F.lit(0).alias("filled"),
        F.lit(0).alias("fillers"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(2**62).cast("long").alias("least"),
    )

    def step(state: Column, at: Column) -> Column:
        into, outof = at["into"], at["outof"]
        bump = lambda c, i: c + (i + 1 == into).cast("int") - (i + 1 == outof).cast("int")
        of = lambda c: F.element_at(state["counts"], F.greatest(c, F.lit(1)))
        # The character is taken out first; when it is the one that comes in, nothing changes.
        rise = F.when(into > 0, F.element_at(table, of(into) + 2) - F.element_at(table, of(into) + 1)).otherwise(F.lit(0).cast("long"))
        fall = F.when(outof > 0, F.element_at(table, of(outof)) - F.element_at(table, of(outof) + 1)).otherwise(F.lit(0).cast("long"))
        now = F.when(into == outof, state["sum"]).otherwise(state["sum"] + rise + fall)
        fillers = state["fillers"] + (into == 0).cast("int") - (outof == 0).cast("int")
        filled = F.least(state["filled"] + 1, F.lit(width))
        least = F.when((filled == width) & (fillers == 0), F.least(state["least"], now)).otherwise(state["least"])
        counts = F.when(into == outof, state["counts"]).otherwise(F.transform(state["counts"], bump))
        return F.struct(counts.alias("counts"), filled.alias("filled"), fillers.alias("fillers"), now.alias("sum"), least.alias("least"))

    return F.aggregate(_let(_codes(value, cls), steps), zero, step, lambda s: s["least"] <= F.lit(least_sum(cls)))


def entropy_spans(text: Column) -> Column:
    """array<struct<start, end, value>> of the candidates of all classes that the allow-list doesn't suppress."""
    return F.array_distinct(F.concat(*[F.filter(located(text, cls.pattern), _kept(cls)) for cls in CLASSES]))


def _kept(cls: CharacterClass):
    def kept(span: Column) -> Column:
        value = span["value"]
        allowed = value.rlike(ALLOWED[0])
        for pattern in ALLOWED[1:]:
            allowed = allowed | value.rlike(pattern)
        return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~allowed, _suspicious(value, cls)).otherwise(F.lit(False))

    return kept


def _assign_ok(s: Column) -> Column:
    return F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and array columns assign, access, hex, entropy of structs (start, end, value), each in order of start."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_spans(texts, "text").select("doc_id", "text", *KINDS)


def with_spans(df: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return df.withColumns(
        {
            "assign": F.filter(located(text, ASSIGN), _assign_ok),
            "access": F.filter(located(text, ACCESS), lambda s: F.char_length(s["value"]) >= ACCESS_LENGTH),
            "hex": located(text, HEX),
            "entropy": entropy_spans(text),
        }
    )


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, then end; joined by commas."""
    tagged = F.array_sort(F.concat(*[_tagged(F.col(k), KINDS.index(k)) for k in kinds]))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1)
    return F.array_join(F.transform(tagged, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scan(docs, id_col, text_col).select("doc_id", *counts, F.sha2(span_text(KINDS[:3]), 256).alias("base_sha256"), span_text(KINDS).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text under one or more spans replaced by the mask; a null text stays null. Other columns may have any names."""
    # The row is held as one column, so that no column of docs can clash with those of the scan.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = with_spans(docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")), "__text")
    spans = F.array_sort(F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    text = F.col("__text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= state["at"]  # else it overlaps the stretch before and only lengthens it
        out = F.when(fresh, F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    held = lambda c: F.col("row").getField(c)
    redacted = F.when(F.size(spans) > 0, clean).otherwise(held(text_col).cast("string"))
    return found.select(*[(redacted if c == text_col else held(c)).alias(c) for c in docs.columns])
