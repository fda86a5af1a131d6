"""Secret scans, in DataFrame functions only: fixed patterns, and a battery of randomness tests.

Candidates of the battery are long runs of key-like characters. Each is taken as text in the smallest
alphabet (encoding) that holds it, and tested for a uniform use of the alphabet (chi-squared), for the
number of runs of its lower and upper half, and for serial correlation of neighbours. Random keys pass
all three. Two things speak against what is no key: how unlikely prose is to be as even as the candidate,
and how unlikely it is to keep to so small an alphabet for so long. The second is measured: over all
candidates that fail the battery, how often a character of the alphabet is followed by another. Both
together are the candidate's p-value, and by encoding and class of length the false-discovery rate over
all documents is held at FDR.
"""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, read

#: Fixed by the contract: the kinds in order, their patterns (a kind's matches may fail a minimum later).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so that a minimum in the pattern gives the same matches as one checked afterwards.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
ASSIGN_MIN = 12

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by size; the first that holds all characters is inferred.
ALPHABETS = (
    _DIGITS,
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _LOWER,
    _UPPER,
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER,
    _DIGITS + _UPPER + _LOWER + "+/",
    _DIGITS + _UPPER + _LOWER + "-_",
    _DIGITS + _UPPER + _LOWER + "+/-_",
)
#: Chance that two letters of prose are equal; upper bounds of the classes of length; battery and FDR levels.
PROSE_MATCH, LENGTHS, MAX_Z, FDR = 0.065, (24, 32, 48, 80), 3.3, 0.01
#: p-values are counted in bins of 1/BINS of a power of ten, down to 10^-LAST.
BINS, LAST = 8, 20
#: Families of alphabets, without regard to case: their characters, and how often one is followed by another
#: where too few candidates tell (as if PRIOR of them had told). The families of ALPHABETS; -1: no family.
#: (Of letters alone there is none: words written together keep to them as long as keys do.)
FAMILIES = (("[0-9]", 0.5), ("[0-9A-Fa-f]", 0.5))
PRIOR = 1000
FAMILY_OF = (0, 1, 1, -1, -1, -1, -1, -1, -1, -1, -1, -1)
#: Members of an array that are folded together, so that long arrays take linear time.
FOLD = 256


def _let(x: Column, body) -> Column:
    """``body`` of x, which is computed once however often it is named there."""
    return F.element_at(F.transform(F.array(x), body), 1)


def before(x: Column, join, zero: int = 0) -> Column:
    """What ``join`` (sum, greatest) makes of all members before each member of an array<int>, and of all at the
    end: one member more than ``x``. Blocks of FOLD are joined first, as each step of a fold copies its array."""
    add = lambda acc, v: F.array_append(acc, join(F.element_at(acc, -1), v))
    start = lambda v: F.array(v).cast("array<int>")

    def through(blocks, heads):
        inner = F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), lambda c, h: F.slice(F.aggregate(c, start(h), add), F.lit(1), F.size(c)))
        return F.concat(F.flatten(inner), F.slice(heads, F.lit(-1), F.lit(1)))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(FOLD)), lambda i: F.slice(x, i + 1, F.lit(FOLD)))
    heads = lambda blocks: F.aggregate(F.transform(blocks, lambda c: F.aggregate(c, F.lit(zero), join)), start(F.lit(zero)), add)
    return _let(x, lambda x: _let(cut(x), lambda blocks: _let(heads(blocks), lambda h: through(blocks, h))))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost matches, as array<struct<start, end, found>> in code points: gaps and matches take turns."""

    def placed(p):
        found = p["found"]
        steps = F.zip_with(found, F.slice(p["gaps"], F.lit(1), F.size(found)), lambda x, gap: F.length(gap) + F.length(x))
        ends = F.slice(before(steps, lambda a, b: a + b), F.lit(2), F.size(found))
        return F.zip_with(found, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("found")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), _let(both, placed)).otherwise(none)


def _lower_tail(z: Column) -> Column:
    """Chance of a standard normal below z; within a few percent also far out."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) * 0.7978845608028654 / (x + F.sqrt(x * x + 2.546479089470325))
    return F.when(z <= 0, tail).otherwise(1 - tail)


def _fields(c: Column, *names: str) -> list[Column]:
    return [c[n].alias(n) for n in names]


def battery(found: Column) -> Column:
    """For array<struct<start, end, found>>: struct<start, end, n, code, z array<double>, p double, kept array> of each.

    ``p`` is of the evenness alone; ``kept`` has for each family how many characters are in it (the last one
    aside), and after how many of those comes another.
    """
    code = lambda s: F.coalesce(*(F.when(F.translate(s, a, "") == "", F.lit(i)) for i, a in enumerate(ALPHABETS)))
    letters = F.array(*(F.lit(a) for a in ALPHABETS))
    one = F.transform(F.transform(found, lambda c: F.struct(*_fields(c, "start", "end", "found"), code(c["found"]).alias("code"))), lambda c: F.struct(*_fields(c, "start", "end", "found", "code"), F.get(letters, c["code"]).alias("a")))

    def keeps(s, family):
        many, runs = F.length(s) - F.length(F.regexp_replace(s, family, "")), F.regexp_count(s, F.lit(family + "+"))
        return F.struct((many - F.when(s.rlike(family + "$"), 1).otherwise(0)).alias("all"), (many - runs).alias("next"))

    def counted(c):
        s, a = c["found"], c["a"]
        k, half = F.length(a), F.floor(F.length(a) / 2).cast("int")
        squares = F.aggregate(F.split(a, ""), F.lit(0).cast("long"), lambda t, x: t + F.pow(F.length(s) - F.length(F.replace(s, x, F.lit(""))), 2).cast("long"))
        low = F.substring(a, F.lit(1), half)
        high = F.substring(a, half + 1, k)
        # upper half to '~', lower half to '!': neither is in an alphabet
        bits = F.call_function("translate", F.call_function("translate", s, high, F.rpad(F.lit("~"), F.length(high), F.lit("~"))), low, F.rpad(F.lit("!"), F.length(low), F.lit("!")))
        at = F.transform(F.split(s, ""), lambda x: F.call_function("instr", a, x).cast("double"))
        kept = F.array(*(keeps(s, family) for family, _ in FAMILIES)).alias("kept")
        return F.struct(*_fields(c, "start", "end", "code"), kept, F.length(s).alias("n"), k.alias("k"), squares.alias("squares"), bits.alias("bits"), at.alias("at"))

    def tested(c):
        n, k = c["n"].cast("double"), c["k"].cast("double")
        chi = c["squares"] * k / n - n
        ups = n - F.length(F.replace(c["bits"], F.lit("~"), F.lit("")))
        downs = n - ups
        turns = lambda x: (n - F.length(F.replace(c["bits"], F.lit(x), F.lit("")))) / 2
        mean, both = 1 + 2 * ups * downs / n, 2 * ups * downs
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (1 + turns("!~") + turns("~!") - mean) / F.sqrt(spread)).otherwise(99.0)
        m = (k + 1) / 2
        add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
        near = F.zip_with(F.slice(c["at"], F.lit(1), c["n"] - 1), F.slice(c["at"], F.lit(2), c["n"] - 1), lambda x, y: (x - m) * (y - m))
        var = add(F.transform(c["at"], lambda x: (x - m) * (x - m)))
        serial = F.when(var > 0, add(near) / F.when(var > 0, var) * F.sqrt(n)).otherwise(99.0)
        more = (n - 1) * (k * F.greatest(F.lit(PROSE_MATCH), 1.3 / k) - 1)
        p = _lower_tail((chi - (k - 1) - more) / F.sqrt(2 * (k - 1) + 4 * more))
        uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        return F.struct(*_fields(c, "start", "end", "n", "code"), F.array(uniform, runs, serial).alias("z"), p.alias("p"), c["kept"].alias("kept"))

    return F.transform(F.transform(one, counted), tested)


def _stratum(c: Column) -> Column:
    """Encoding and class of length."""
    return c["code"] * (len(LENGTHS) + 1) + sum((F.when(c["n"] >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))


def _bin(c: Column, stay: list[float]) -> Column:
    """Of the p-value: that prose stays in the alphabet, and then is so even."""
    log_stay = F.get(F.array(*(F.lit(x) for x in stay)), c["code"]) * (c["n"] - 1)
    return F.least(F.lit(BINS * LAST), F.floor(-(F.log10(F.greatest(c["p"], F.lit(1e-300))) + log_stay) * BINS)).cast("int")


def _passes(c: Column) -> Column:
    return ~F.exists(c["z"], lambda z: F.abs(z) > MAX_Z)


def _bare(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _cairn_base (sorted spans of the fixed patterns) and _cairn_try (tested candidates that overlap none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    strong = lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_MIN
    named = lambda k, xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    base = F.array_sort(F.concat(named(0, F.filter(spans(text, ASSIGN), strong)), named(1, spans(text, ACCESS)), named(2, spans(text, HEX))))
    free = lambda x: ~F.exists("_cairn_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return docs.withColumn("_cairn_base", base).withColumn("_cairn_try", battery(F.filter(spans(text, CANDIDATE), free)))


def staying(tried: DataFrame) -> list[float]:
    """By alphabet, the logarithm (to ten) of how often prose stays in it for another character."""
    failed = tried.select(F.explode("_cairn_try").alias("c")).filter(~_passes(F.col("c")))
    sums = failed.agg(*(F.sum(F.get("c.kept", F.lit(k))[name]).alias(f"{name}{k}") for k in range(len(FAMILIES)) for name in ("all", "next"))).first()
    rate = [((sums[f"next{k}"] or 0) + PRIOR * p) / ((sums[f"all{k}"] or 0) + PRIOR) for k, (_, p) in enumerate(FAMILIES)]
    return [log10(min(1.0, rate[k])) if k >= 0 else 0.0 for k in FAMILY_OF]


def limits(tried: DataFrame, stay: list[float]) -> list[int]:
    """By stratum, the smallest bin whose candidates are discoveries (Benjamini-Hochberg over bins)."""
    c = F.col("c")
    counts = tried.select(F.explode("_cairn_try").alias("c")).groupBy(_stratum(c).alias("of"), F.when(_passes(c), _bin(c, stay)).otherwise(-1).alias("bin")).count()
    rows = counts.collect()  # strata times BINS * LAST + 2 rows at most
    found = []
    for k in range(len(ALPHABETS) * (len(LENGTHS) + 1)):
        own = {r["bin"]: r["count"] for r in rows if r["of"] == k}
        every, reach = sum(own.values()), 0
        best = BINS * LAST + 1
        for b in range(BINS * LAST, -1, -1):
            reach += own.get(b, 0)
            if reach and 10 ** (-b / BINS) <= FDR * reach / every:
                best = b
        found.append(best)
    return found


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: array<struct<start, kind, end>>, sorted; kind is an index into KINDS.

    Whole texts are read; offsets count code points, the end is exclusive. Null and empty texts have none.
    Repeated rows have the same spans; other columns pass through (one named as ``into`` is replaced); an
    empty table gives no rows. A very long run of key characters is one candidate. Texts are searched once;
    what is found is written beside them, then counted, then judged.
    """
    tried = materialize(_bare(docs, text_col))
    stay = staying(tried)
    least = F.array(*(F.lit(b) for b in limits(tried, stay)))
    good = F.filter("_cairn_try", lambda c: _passes(c) & (_bin(c, stay) >= F.get(least, _stratum(c))))
    more = F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return tried.withColumn(into, F.array_sort(F.concat("_cairn_base", more))).drop("_cairn_base", "_cairn_try")


def redact(found: DataFrame, text_col: str = "text", by: str = "[SECRET]", secrets_col: str = "secrets") -> DataFrame:
    """``text`` with every span of ``secrets_col`` replaced (spans that overlap: once), and without that column."""
    text, own = F.col(text_col), F.col(secrets_col)

    def masked(reach):
        kept = F.zip_with(own, F.slice(reach, F.lit(1), F.size(own)), lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(by))).otherwise(""))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    new = _let(before(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), masked)
    return found.withColumn(text_col, F.when(F.size(own) > 0, new).otherwise(text)).drop(secrets_col)


def written(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
