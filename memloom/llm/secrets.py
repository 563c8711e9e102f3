"""Op 10. Secret scans: fixed patterns and sliding-window Shannon entropy (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in the order of the listing, with their patterns. Of ``assign``, group 2 needs 8
#: characters; runs that are too short are dropped, which for the other two is the same as asking for the length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Character classes of the entropy scan: (kind, candidate pattern, window, bits a character).
CLASSES = (
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
    ("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0),
)
#: Candidates that are no secrets: without a digit or without a letter, identifiers with dashes of UUID form, and paths.
#: The groups are possessive, so that a long path is matched in a loop and not by recursion.
ALLOW = r"^[^0-9]*$|^[^A-Za-z]*$|^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^/?(?:[A-Za-z0-9_-]{1,15}/)++[A-Za-z0-9_-]{0,15}$"


#: Base kinds: (kind, pattern, group that holds the value, least length of the value).
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0))
#: Rounding of sums of logarithms: entropies nearer than this to the bits reach them.
ROUNDING = 1e-9
#: Windows that one fold goes through.
STRIDE = 96


def _pieces(gaps: str, found: str, values: str) -> Column:
    """The text as (gap, hit, value) of each match; what follows the last match is left out."""
    return F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.col(found).alias("hit"), F.col(values).alias("value"))


def spans(pieces: Column, kind: str, rank: int) -> Column:
    """Spans (start, rank, kind, end, value) of leftmost non-overlapping matches, in code points.

    The text between the matches and the matches themselves make up the text, so their running lengths are the
    positions. They are summed up in chunks of about the square root of their number, as an array that grows match by match
    would be copied as often.
    """
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(pieces).cast("double"))).cast("int"))
    whole = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    chunks = F.transform(F.sequence(F.lit(1), F.size(pieces), width), lambda i: F.slice(pieces, i, width))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + whole(x)))

    def next_start(acc, n):
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    starts = F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), next_start)["out"]

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        row = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    placed = F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("at")), lambda z: F.aggregate(z["c"], F.struct(z["at"].alias("at"), none.alias("out")), step)["out"])
    return F.when(F.size(pieces) > 0, F.flatten(placed)).otherwise(none)


def _blanked(text: str, gaps: str, pieces: Column, found) -> Column:
    """The text with spaces in place of the matches that are ``found``; places stay the same."""
    parts = F.transform(pieces, lambda x: F.concat(x["gap"], F.when(found(x), F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(x["hit"])))
    return F.when(F.size(pieces) > 0, F.concat(F.array_join(parts, ""), F.element_at(F.col(gaps), -1))).otherwise(F.col(text))


def reaches(value: Column, window: int, bits: float) -> Column:
    """Whether any ``window`` consecutive characters of ``value`` (ASCII) have a Shannon entropy of ``bits`` a character.

    The entropy of a window is log2(window) less the sum of n * log2(n) over its counts n, by window. The sum is
    carried along: the character that enters and the one that leaves change one count each, which is looked up in the
    window's few characters. A fold goes over ``STRIDE`` windows, and the search ends with the first fold that finds one.
    """
    size = lambda n: n * math.log2(n) if n else 0.0
    gain = F.array(*[F.lit(size(n + 1) - size(n)) for n in range(window)])  # of a count of n that becomes n + 1
    most = window * (math.log2(window) - bits + ROUNDING)

    def search(block):
        part = lambda at, n: F.call_function("substring", block, at, n)
        count = lambda within, c: F.length(within) - F.length(F.replace(within, c, F.lit("")))

        def step(acc, i):
            first = F.greatest(i - (window - 1), F.lit(1))  # of the window that ends with i
            enters = acc["s"] + F.get(gain, count(part(first, i - first), part(i, F.lit(1))))
            full = i >= window
            leaves = enters - F.get(gain, count(part(first + 1, i - first), part(first, F.lit(1))))
            low = F.when(full, F.least(acc["low"], enters)).otherwise(acc["low"])
            return F.struct(F.when(full, leaves).otherwise(enters).alias("s"), low.alias("low"))

        start = F.struct(F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))
        return F.aggregate(F.sequence(F.lit(1), F.length(block)), start, step)["low"] <= most

    blocks = F.regexp_extract_all(value, F.lit(f".{{1,{STRIDE}}}"), F.lit(0))
    # an array of one names the blocks, which would else be made anew for each of them
    joined = lambda every: F.transform(every, lambda b, k: F.concat(b, F.coalesce(F.substring(F.get(every, k + 1), 1, window - 1), F.lit(""))))
    return F.exists(F.array(blocks), lambda every: F.exists(joined(every), search))


def _label(m: Column) -> Column:
    return F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))


def scan(docs: DataFrame, classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """Spans of each document: doc_id, base and found, arrays of (start, rank, kind, end, value).

    ``base`` holds the fixed patterns' matches, whatever else is found. ``found`` adds candidate strings of each
    character class that reach the class's bits in a window and that ``allow`` doesn't match. Candidates are looked for outside
    of assign spans and of spans of the classes before; those that hold an access or hex match are left out, too. All
    steps take time in proportion to the text (matches to the power 1.5), however long it or its matches are. Null
    text is empty and gives no span; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    # in steps, so that no pattern runs twice over a text
    def matched(d: DataFrame, text: str, pattern: str, group: int, i: int) -> DataFrame:
        d = d.select("*", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"hit{i}"))
        some = F.size(f"hit{i}") > 0
        none = F.array().cast("array<string>")
        d = d.select("*", F.when(some, F.split(text, pattern, -1)).otherwise(none).alias(f"gap{i}"), (F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col(f"hit{i}")).alias(f"value{i}"))
        return d.select("*", _pieces(f"gap{i}", f"hit{i}", f"value{i}").alias(f"piece{i}")).drop(f"hit{i}", f"value{i}")

    for i, (kind, pattern, group, least) in enumerate(BASE):
        d = matched(d, "text", pattern, group, i)
        d = d.withColumn(f"m{i}", F.filter(spans(F.col(f"piece{i}"), kind, i), lambda m: F.length(m["value"]) >= least))
        if kind == "assign":
            d = d.withColumn("open", _blanked("text", f"gap{i}", F.col(f"piece{i}"), lambda x: F.length(x["value"]) >= least))
        d = d.drop(f"gap{i}", f"piece{i}")
    held = "|".join(f"(?:{p})" for k, p, *_ in BASE if k != "assign")
    for i, (kind, pattern, window, bits) in enumerate(classes, len(BASE)):
        d = matched(d, "open", pattern, 0, i)
        secret = lambda x: ~x["hit"].rlike(held) & ~x["hit"].rlike(allow) & reaches(x["hit"], window, bits)
        judged = F.transform(F.col(f"piece{i}"), lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.when(secret(x), x["hit"]).alias("value")))
        d = d.withColumn(f"piece{i}", judged)
        d = d.withColumn(f"m{i}", F.filter(spans(F.col(f"piece{i}"), kind, i), lambda m: m["value"].isNotNull()))
        d = d.withColumn("open", _blanked("open", f"gap{i}", F.col(f"piece{i}"), lambda x: x["value"].isNotNull())).drop(f"gap{i}", f"piece{i}")
    base = [f"m{i}" for i in range(len(BASE))]
    every = [f"m{i}" for i in range(len(BASE) + len(classes))]
    return d.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*every)).alias("found"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Digest of the scan: counts per base kind, the hash of the base spans, and all spans as text."""
    s = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, _label), ",")
    return s.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
