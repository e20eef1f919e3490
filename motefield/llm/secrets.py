"""Secret scan in DataFrame functions: fixed patterns, and a battery of randomness tests for everything else.

A candidate is a long run of characters that encodings use. Its encoding is inferred from its characters. Three tests say
whether the run looks like uniform symbols of that encoding: chi-squared of the symbol counts, the number of runs of
character classes, and the correlation of neighbouring symbols. Two of them are also held against ordinary text, whose symbol
frequencies are counted over the whole table, which gives a p-value for "an ordinary run would look this random". Lengths enter
twice: through the variances of the tests and through a false-discovery control per length band. Reported are the
candidates that are discoveries against ordinary text and that uniform symbols explain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import free_names
from motefield.runtime import new_table_path

# Fixed patterns by kind, in the order of reports: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
KINDS = [*BASE, "random"]
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encodings from the narrowest: what its runs look like, and its symbols.
ENCODINGS = {
    "decimal": ("^[0-9]+$", DIGITS),
    "hex_lower": ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    "hex_upper": ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    "base32": ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    "base62": ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    "mixed": ("", UPPER + LOWER + DIGITS + "+/-_"),
}
SYMBOLS = ENCODINGS["mixed"][1]
# Length bands within which false discoveries are controlled, the rate allowed, and the level of the tests of uniformity.
BANDS = (20, 28, 40, 64)
RATE, UNIFORM_Q = 0.01, 21.11  # chi-squared with three degrees of freedom at 1e-4
# Values folded at once, and a place beyond any text.
BLOCK, LAST = 128, 2**31 - 1
# p-values are binned at a tenth of a decade down to 1e-40.
BINS = 400


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often the body reads it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` values."""
    whole = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    return F.when(F.size(values) > 0, F.transform(whole, lambda k: F.slice(values, k * BLOCK + 1, BLOCK))).otherwise(F.slice(F.array(values), 1, 0))


def folded_before(values: Column, start: int, fold: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, the fold of all before it.

    A plain running fold copies what it has at each step, which is quadratic; here blocks are folded first, then each block
    runs from the fold of the blocks before it.
    """
    first = F.lit(start).cast("int")

    def running(some: Column, at: Column) -> Column:
        empty = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, empty, lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda b: F.aggregate(b, first, fold)), first)
        return F.flatten(F.zip_with(blocks, starts, running))

    return bound(values, lambda all_: bound(in_blocks(all_), of_blocks))


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs of start, end and text; start and end in code points.

    A text is only cut up if the pattern occurs in it. Matches whose group is too short are dropped after the search. The work grows
    about in proportion to text and matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(whole, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.arrays_zip(whole.alias("found"), sized.alias("sized")), gaps, lambda m, gap: F.struct(gap.alias("gap"), m["found"].alias("found"), m["sized"].alias("sized")))
    matches = F.filter(pairs, lambda p: p["found"].isNotNull())

    def placed(all_: Column) -> Column:
        before = folded_before(F.transform(all_, lambda p: p["gap"] + F.length(p["found"])), 0, lambda at, x: at + x)
        return F.zip_with(all_, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["found"])).alias("end"), p["found"].alias("found"), p["sized"].alias("sized")))

    kept = F.transform(F.filter(bound(matches, placed), lambda s: s["sized"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def symbol_counts(texts: DataFrame) -> dict[str, int]:
    """How often each symbol occurs in the whole column ``text``.

    Texts are read once: runs of symbols are counted, equal ones together before the shuffle, and symbols are taken from the distinct runs.
    """
    runs = texts.select(F.explode(F.split("text", "[^A-Za-z0-9+/_-]+")).alias("run")).groupBy("run").agg(F.count("*").alias("times"))
    sums = [F.sum((F.octet_length("run") - F.octet_length(F.replace(F.col("run"), F.lit(c), F.lit("")))) * F.col("times")) for c in SYMBOLS]
    row = runs.agg(*sums).first()
    return {c: int(n or 0) + 1 for c, n in zip(SYMBOLS, row)}


def class_of(symbol: str) -> int:
    return 0 if symbol in UPPER else 1 if symbol in LOWER else 2 if symbol in DIGITS else 3


def moments(symbols: str, weights: Iterable[float]) -> dict[str, float]:
    """What the mean and variance of both tests need of a distribution over symbols."""
    total = float(sum(weights := list(weights)))
    q = [w / total for w in weights]
    classes = [sum(p for p, s in zip(q, symbols) if class_of(s) == c) for c in range(4)]
    change = 1 - sum(p * p for p in classes)
    return {
        "two": sum(p**2 for p in q),
        "three": sum(p**3 for p in q),
        "change": change,
        "both": sum(p * (1 - p) ** 2 for p in classes) - change**2,
    }


def per_encoding(encoding: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(encoding == name, F.lit(float(value))).otherwise(out)
    return out


def excess(n: Column, squares: Column, at: dict[str, Column]) -> Column:
    """Standardised sum of squared symbol counts under a distribution; low for symbols that are spread more evenly."""
    mean = n + n * (n - 1) * at["two"]
    spread = at["two"] * at["two"]
    variance = 2 * n * (n - 1) * (at["two"] - spread) + 4 * n * (n - 1) * (n - 2) * F.greatest(F.lit(0.0), at["three"] - spread)
    return (squares - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))


def run_excess(n: Column, runs: Column, at: dict[str, Column]) -> Column:
    """Standardised number of class runs under a distribution."""
    mean = 1 + (n - 1) * at["change"]
    variance = (n - 1) * at["change"] * (1 - at["change"]) + 2 * (n - 2) * at["both"]
    return (runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))


def tail_bin(z: Column) -> Column:
    """Tenths of a decade of the upper normal tail at z, rounded down: larger for smaller p-values.

    The tail is the Chebyshev fit of the complementary error function, taken in logarithms.
    """
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of the fit (fixed values), from the constant term on.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for c in reversed(fit):
        poly = poly * t + c
    return F.least(F.lit(BINS), F.floor(-10 * (F.log(t) - x * x + poly - math.log(2)) / math.log(10)).cast("int"))


def tested(spans: Column, counts: dict[str, int]) -> Column:
    """Candidates with their length band, p-value bin against ordinary text and fit to uniform symbols."""

    def read(s: Column) -> Column:
        body = F.regexp_replace(s["found"], "=+$", "")
        encoding = F.lit("mixed")
        for name, (pattern, _) in reversed(list(ENCODINGS.items())[:-1]):
            encoding = F.when(body.rlike(pattern), name).otherwise(encoding)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.filter(F.split(body, ""), lambda c: c != "").alias("chars"), encoding.alias("encoding"))

    def classed(c: Column) -> Column:
        return F.when(c.between("A", "Z"), 0).when(c.between("a", "z"), 1).when(c.between("0", "9"), 2).otherwise(3)

    def number(s: Column) -> Column:
        symbols = F.lit(SYMBOLS)
        for name, (_, alphabet) in ENCODINGS.items():
            symbols = F.when(s["encoding"] == name, alphabet).otherwise(symbols)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), F.size(s["chars"]).cast("double").alias("n"),
            F.aggregate(F.array_distinct(s["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(s["chars"], lambda x: x == c)), 2)).alias("squares"),
            F.transform(s["chars"], lambda c: F.position(c, symbols).cast("double")).alias("values"),
            F.transform(s["chars"], classed).alias("classes"),
        )

    def measure(s: Column) -> Column:
        after = F.slice(s["classes"], 2, F.size(s["classes"]))
        runs = 1 + F.size(F.filter(F.zip_with(F.slice(s["classes"], 1, F.size(s["classes"]) - 1), after, lambda a, b: a != b), lambda x: x))
        mean = F.aggregate(s["values"], F.lit(0.0), lambda acc, v: acc + v) / s["n"]
        square = F.aggregate(s["values"], F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        product = F.aggregate(
            F.zip_with(F.slice(s["values"], 1, F.size(s["values"]) - 1), F.slice(s["values"], 2, F.size(s["values"])), lambda a, b: (a - mean) * (b - mean)),
            F.lit(0.0), lambda acc, v: acc + v,
        )
        serial = F.when(square > 0, product / square).otherwise(1.0)
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "encoding", "n", "squares")], runs.cast("double").alias("runs"), serial.alias("serial"))

    even = {name: moments(a, [1] * len(a)) for name, (_, a) in ENCODINGS.items()}
    plain = {name: moments(a, [counts[c] for c in a]) for name, (_, a) in ENCODINGS.items()}
    freedom = {name: len(a) - 1 for name, (_, a) in ENCODINGS.items()}

    def judge(s: Column) -> Column:
        n = s["n"]
        ordinary, uniform = ({k: per_encoding(s["encoding"], {e: m[k] for e, m in kind.items()}) for k in ("two", "three", "change", "both")} for kind in (plain, even))
        df = per_encoding(s["encoding"], freedom)
        chi = F.greatest(s["squares"] * (df + 1) / n - n, F.lit(0.0))
        chi_z = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        against = (run_excess(n, s["runs"], ordinary) - excess(n, s["squares"], ordinary)) / math.sqrt(2)
        fit = F.pow(F.greatest(chi_z, F.lit(0.0)), 2) + F.pow(run_excess(n, s["runs"], uniform), 2) + F.pow(s["serial"], 2) * n
        band = F.lit(0)
        for i, least in enumerate(BANDS):
            band = F.when(n >= least, i).otherwise(band)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), band.alias("band"), tail_bin(against).alias("bin"), (fit <= UNIFORM_Q).alias("uniform"))

    for stage in (read, number, measure, judge):
        spans = F.transform(spans, stage)
    return spans


def discovery_bins(candidates: DataFrame) -> dict[int, int]:
    """The least p-value bin that counts as a discovery in each length band (Benjamini and Hochberg).

    ``candidates`` holds ``band`` and ``bin``; what comes to the driver is one count for each of at most 4 x 401 bins.
    """
    counts: dict[int, dict[int, int]] = {}
    for row in candidates.groupBy("band", "bin").count().collect():
        counts.setdefault(row["band"], {})[row["bin"]] = row["count"]
    out = {}
    for band, by_bin in counts.items():
        total, passed = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            passed += by_bin[b]
            if 10 ** (-b / 10) <= RATE * passed / total:
                out[band] = b
    return out


def of_kind(kind: int):
    return lambda span: F.struct(span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end"))


def count_of(kind: int) -> Column:
    return F.size(F.filter("secrets", lambda span: span["kind"] == kind)).cast("long")


def untouched(spans: Column, base: Column) -> Column:
    """Start and end of those ``spans`` that share no place with a base span; no span is held against all base spans."""
    merged = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("is_span"), s["end"].alias("end"))),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("is_span"), s["end"].alias("end"))),
    ))

    def marked(rows: Column) -> Column:
        last_end = folded_before(F.transform(rows, lambda r: F.when(r["is_span"] == 0, r["end"]).otherwise(0)), 0, lambda at, x: F.greatest(at, x))
        starts = F.reverse(F.transform(rows, lambda r: F.when(r["is_span"] == 0, r["start"]).otherwise(LAST)))
        next_start = F.reverse(folded_before(starts, LAST, lambda at, x: F.least(at, x)))
        joined = F.zip_with(rows, F.arrays_zip(last_end.alias("e"), next_start.alias("s")), lambda r, n: F.struct(r.alias("r"), ((n["e"] > r["start"]) | (n["s"] < r["end"])).alias("hit")))
        return F.transform(F.filter(joined, lambda j: (j["r"]["is_span"] == 1) & ~j["hit"]), lambda j: F.struct(j["r"]["start"].alias("start"), j["r"]["end"].alias("end")))

    return bound(merged, marked)


def scan(docs: DataFrame, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """Add ``secrets`` (or another ``name``): array of (start, kind number, end) in report order, base kinds first where they start together.

    A null text counts as empty and has none; an empty table gives an empty one; repeated rows are scanned alike; a text of any length is
    scanned whole, by one task; all other columns stay, unless one is called like the added one, which is replaced. Random runs that touch a
    base span are left out, as they are reported already.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = symbol_counts(docs.select(text.alias("text")))
    base = [F.transform(found(text, *spec), of_kind(k)) for k, spec in enumerate(BASE.values())]
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    base_name, tested_name = free_names(kept, ["base", "tested"])
    marked = docs.select(*[F.col(f"`{c}`") for c in kept], F.concat(*base).alias(base_name), tested(found(text, CANDIDATE, 0, BANDS[0]), counts).alias(tested_name))
    path = new_table_path(spark, "secrets")
    marked.write.option("compression", "zstd").parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    least = discovery_bins(marked.select(F.explode(tested_name).alias("t")).select("t.band", "t.bin"))

    def discovered(t: Column) -> Column:
        passed = F.lit(False)
        for band, b in least.items():
            passed = passed | ((t["band"] == band) & (t["bin"] >= b))
        return passed & t["uniform"]

    passed = F.transform(F.filter(tested_name, discovered), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    random = F.when(F.size(passed) > 0, untouched(passed, F.col(base_name))).otherwise(passed)
    return marked.withColumn(name, F.array_sort(F.concat(base_name, F.transform(random, of_kind(len(BASE)))))).drop(base_name, tested_name)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``: one row per row, ids may repeat or be null."""
    out = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    numbers = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *numbers, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by ``marker``, overlapping spans by one; clean and null texts and all other columns stay as they are.

    Nothing is dropped; repeated rows are masked alike; an empty table gives an empty one. The text is cut in two steps, by blocks of
    spans and within each, so that a text with very many spans is not read from its start for each of them.
    """
    (name,) = free_names(docs.columns, ["secrets"])
    out = scan(docs, text_col, name)
    text = F.col(text_col)

    def masked(spans: Column) -> Column:
        covered = folded_before(F.transform(spans, lambda s: s["end"]), 0, lambda at, x: F.greatest(at, x))
        seen = F.zip_with(spans, covered, lambda s, at: F.struct(at.alias("from"), s["start"].alias("to"), s["end"].alias("end")))
        first = F.filter(seen, lambda s: s["to"] >= s["from"])
        # A gap runs from where the spans before it end to the next span; the last one to the end of the text.
        rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), F.length(text).alias("to"), F.length(text).alias("end"))
        return bound(F.concat(first, F.array(rest)), lambda all_: F.array_join(F.flatten(F.transform(in_blocks(all_), cut)), marker))

    def cut(block: Column) -> Column:
        start = F.element_at(block, 1)["from"]
        part = F.substring(text, start + 1, F.element_at(block, -1)["to"] - start)
        return bound(part, lambda own: F.transform(block, lambda s: F.substring(own, s["from"] - start + 1, s["to"] - s["from"])))

    clean = F.when(F.size(name) > 0, bound(F.col(name), masked)).otherwise(text)
    return out.withColumn(text_col, clean).select(*[f"`{c}`" for c in docs.columns])
