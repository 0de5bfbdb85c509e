"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Only DataFrame functions run here. Positions come from the pieces between matches: a pattern's matches and the text
split by the same pattern give every start and end in code points.

The battery takes the long runs of key-like characters outside the patterns' spans and their parts between slashes,
infers each one's encoding (decimal, hex, base32, base64) and tests it against ordinary identifiers of that encoding,
which are the null hypothesis:

* chi-squared: how far the counts of the alphabet's symbols are from uniform; an ordinary token is far from it;
* runs: how often neighbours are of different class (capital, small letter, digit; small and large digit of a
  decimal); an ordinary token seldom changes class;
* serial correlation of neighbouring symbols' places in the alphabet; an ordinary token's is positive.

The three scores are summed, and the sum is held against the sums of the table's own tokens of that encoding: their
median and lower quartile give the null distribution, so the tests' dependence and the corpus's habits are in it. Over
all tokens of the table the Benjamini-Hochberg rule with weights in proportion to length (mean 1) bounds the share of
false discoveries: long tokens, which carry more evidence, get more of the budget. The null and the rule need one
histogram over the whole table; a few numbers of it reach the driver, and the spans are then found in a second pass
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm._common import Scratch

#: The base patterns, and the kinds in the order of their listing.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")

#: Runs of key-like characters that the battery tests, of LEAST_TESTED letters and digits or more, and their parts between
#: slashes, which are tested beside the whole run: a slash may belong to a key or stand before it in a path.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}+={0,2}"

SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class Encoding:
    """An alphabet, the class of each of its symbols for the runs test, the pattern of its tokens, and what ordinary
    tokens look like in it: ``excess`` is the chi-squared statistic a symbol adds over the uniform expectation."""

    name: str
    alphabet: str
    classes: str
    pattern: str
    excess: float


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: In the order of inference: the first whose pattern fits. base64 is tested without its two signs, which join words in
#: ordinary identifiers and paths.
ENCODINGS = (
    Encoding("decimal", _DIGIT, "SSSSSGGGGG", r"^[0-9]+$", 0.8),
    Encoding("hex", _DIGIT + "abcdef", "D" * 10 + "L" * 6, r"^([0-9a-f]+|[0-9A-F]+)$", 0.9),
    Encoding("base32", _UPPER + "234567", "U" * 26 + "D" * 6, r"^[A-Z2-7]+$", 1.2),
    Encoding("base64", _UPPER + _LOWER + _DIGIT, "U" * 26 + "L" * 26 + "D" * 10, r"", 3.2),
)
LEAST_TESTED = 16
#: Ordinary tokens' share of neighbours of different class, and their serial correlation.
CHANGES, CORRELATION = 0.15, 0.35
#: Share of false discoveries; steps of scores and of -log10(p) in the histogram; tokens that stand for the model's own
#: null distribution beside those seen; items of an array that are worked on at a time.
RATE, BIN, PRIOR, BLOCK = 0.01, 0.05, 1000, 32


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, an array, which is made once however often it is used; empty if it is."""
    return F.flatten(F.transform(F.array(value), body))


def _blocks(items: Column) -> Column:
    """An array that isn't empty, in pieces of BLOCK items, so that appending to a piece stays cheap."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _starts(text: Column, pattern: str) -> Column:
    """array<struct<at, n>>: where each match begins and how long it is."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n")))
    item, place = "struct<gap:int,n:int>", "struct<at:int,n:int>"

    def dated(items: Column) -> Column:
        # each block with the place where it begins, then each match within its block
        zero = F.struct(F.lit(0).alias("to"), F.array().cast(f"array<struct<since:int,block:array<{item}>>>").alias("out"))
        total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])
        since = F.aggregate(
            _blocks(items), zero,
            lambda acc, x: F.struct((acc["to"] + total(x)).alias("to"), F.concat(acc["out"], F.array(F.struct(acc["to"].alias("since"), x.alias("block")))).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.transform(since, lambda b: F.aggregate(
            b["block"], F.struct(b["since"].alias("to"), F.array().cast(f"array<{place}>").alias("out")),
            lambda acc, x: F.struct((acc["to"] + x["gap"] + x["n"]).alias("to"), F.concat(acc["out"], F.array(F.struct((acc["to"] + x["gap"]).alias("at"), x["n"].alias("n")))).alias("out")),
            lambda acc: acc["out"],
        )))

    return _once(lengths, lambda items: F.when(F.size(items) > 0, dated(items)).otherwise(F.array().cast(f"array<{place}>")))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _span(kind: str, at: Column, n: Column) -> Column:
    return F.struct(at.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + n).cast("int").alias("end"))


def _base(text: Column) -> dict[str, Column]:
    """The spans of each base kind; a text without a kind's mark costs one search."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(_starts(text, ASSIGN), values, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, _span("assign", s["at"], s["n"])))
    return {
        "assign": F.when(text.rlike(ASSIGN), F.filter(assign, lambda s: s.isNotNull())).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), F.transform(_starts(text, ACCESS), lambda s: _span("access", s["at"], s["n"]))).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), F.transform(_starts(text, HEX), lambda s: _span("hex", s["at"], s["n"]))).otherwise(_none()),
    }


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tested_as(token: Column) -> Column:
    """struct<encoding, z> of a token: the place of its encoding in ENCODINGS, and the battery's score."""

    def told(folded: Column) -> Column:
        which = F.lit(len(ENCODINGS) - 1)
        for k, e in reversed(list(enumerate(ENCODINGS[:-1]))):
            which = F.when(folded.rlike(e.pattern), F.lit(k)).otherwise(which)
        return _bind(which, lambda k: F.struct(k.alias("encoding"), _battery(folded, k).alias("z")))

    return _bind(F.translate(token, "-_+/=", ""), told)


def _battery(folded: Column, which: Column) -> Column:
    """The sum of the three tests' scores for a token of the encoding at place ``which``."""
    of = lambda f: F.element_at(F.array(*[F.lit(f(e)) for e in ENCODINGS]), which + 1)
    x = F.when(which == [e.name for e in ENCODINGS].index("hex"), F.lower(folded)).otherwise(folded)
    alphabet, k, excess = of(lambda e: e.alphabet), of(lambda e: float(len(e.alphabet))), of(lambda e: e.excess)

    def tests(t: Column) -> Column:
        n = F.size(t["chars"]).cast("double")
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
        # chi-squared against uniform; n minus what is left without a symbol is the symbol's count
        squares = total(F.transform(F.array_distinct(t["chars"]), lambda c: F.pow(n - F.length(F.replace(t["x"], c, F.lit(""))), F.lit(2.0))))
        z_chi = (n * excess + (k - 1) - (squares * k / n - n)) / F.sqrt(2 * (n * (2 * excess) + (k - 1)))
        # neighbours of different class; a capital that begins a word is of its word's class, as in getElementsByName
        classes = F.regexp_replace(F.call_function("translate", t["x"], alphabet, of(lambda e: e.classes)), "U(?=L)", "L")
        changes = F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")) - 1
        z_runs = (changes - (n - 1) * CHANGES) / F.sqrt((n - 1) * (CHANGES * (1 - CHANGES)))

        def serial(places: Column) -> Column:
            # lag-1 correlation of places in the alphabet, by sums, so that the time is in proportion to the token
            s, ends = total(places), F.get(places, F.lit(0)) + F.get(places, F.size(places) - 1)
            m = s / n
            var = total(F.transform(places, lambda v: v * v)) - s * m
            steps = F.size(places) - 1
            pairs = total(F.zip_with(F.slice(places, F.lit(1), steps), F.slice(places, F.lit(2), steps), lambda a, b: a * b))
            r = (pairs - m * (2 * s - ends) + (n - 1) * m * m) / F.greatest(var, F.lit(1e-9))
            return (F.lit(CORRELATION) - r) * F.sqrt(n) / (1 - CORRELATION**2)

        places = F.transform(t["chars"], lambda c: F.instr(t["alphabet"], c).cast("double"))
        return (z_chi + z_runs + _bind(places, serial)) / 3**0.5

    return _bind(F.struct(x.alias("x"), alphabet.alias("alphabet"), F.filter(F.split(x, ""), lambda c: c != "").alias("chars")), tests)


def _upper_tail(z: Column) -> Column:
    """-log10 of the normal distribution's upper tail (Abramowitz and Stegun 26.2.17); negative z count as 0."""
    z = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + z * 0.2316419)
    tail = t * (t * (t * (t * (t * 1.330274429 - 1.821255978) + 1.781477937) - 0.356563782) + 0.319381530)
    return z * z / 4.605170186 + 0.399089934 - F.log10(tail)


def _candidates(text: Column, taken: Column) -> Column:
    """array<struct<span, n, encoding, bin>> of the runs, and of their parts between slashes, outside the spans of ``taken``."""
    # spans' characters become asterisks, which belong to no run, so that what is left of a run is tested
    free = F.when(F.size(taken) > 0, masked(text, F.array_sort(taken))).otherwise(text)
    return _once(free, _tested)


def _tested(text: Column) -> Column:
    """The runs of a text and their parts, with their scores."""
    runs = F.zip_with(_starts(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda s, t: F.struct(s["at"].alias("at"), t.alias("token")))

    def parts(run: Column, cut: Column) -> Column:
        before = lambda i: F.length(F.array_join(F.slice(cut, F.lit(1), i), "/")) + F.when(i > 0, 1).otherwise(0)
        return F.transform(cut, lambda p, i: F.struct((run["at"] + before(i)).cast("int").alias("at"), p.alias("token")))

    every = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.when(F.contains(r["token"], F.lit("/")), _once(F.split(r["token"], "/"), lambda cut: parts(r, cut))).otherwise(F.array().cast("array<struct<at:int,token:string>>")))))
    long = F.filter(every, lambda s: F.length(F.translate(s["token"], "-_+/=", "")) >= LEAST_TESTED)
    told = F.transform(long, lambda s: F.struct(_span("random", s["at"], F.length(s["token"])).alias("span"), F.length(F.rtrim(s["token"], F.lit("="))).alias("n"), _tested_as(F.rtrim(s["token"], F.lit("="))).alias("as")))
    scored = F.transform(told, lambda s: F.struct(s["span"].alias("span"), s["n"].alias("n"), s["as"]["encoding"].alias("encoding"), F.floor(s["as"]["z"] / BIN).cast("int").alias("bin")))
    empty = F.array().cast(f"array<struct<span:{SPAN},n:int,encoding:int,bin:int>>")
    return F.when(text.rlike(CANDIDATE), scored).otherwise(empty)


@dataclass(frozen=True)
class Cut:
    """The null distribution of each encoding's scores as (middle, spread), the mean length of a token, and the least
    weighted -log10(p) that is a discovery (None: nothing is)."""

    null: tuple[tuple[float, float], ...]
    mean: float
    least: int | None

    def level(self, encoding: Column, bin: Column, n: Column) -> Column:
        """The weighted -log10(p) of a token, in steps of BIN."""
        middle, spread = (F.element_at(F.array(*[F.lit(x[i]) for x in self.null]), encoding + 1) for i in (0, 1))
        return F.floor((_upper_tail((bin * BIN - middle) / spread) + F.log10(n / F.lit(self.mean))) / BIN).cast("long")


def fitted_null(binned: DataFrame) -> tuple[tuple[float, float], ...]:
    """(middle, spread) of each encoding's scores over all tokens, from ``binned`` (encoding, n, bin, count).

    The median and the distance of the lower quartile from it, which discoveries hardly move; they are weighed against
    the model's own (0, 1) as if PRIOR tokens had been seen that follow it. The spread is at least 1.
    """
    bins = binned.groupBy("encoding", "bin").agg(F.sum("count").alias("count"))
    by = W.partitionBy("encoding")
    upto = bins.withColumns({"upto": F.sum("count").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("count").over(by)})
    quarter = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin")))
    rows = upto.groupBy("encoding").agg(F.max("all").alias("n"), quarter(1).alias("low"), quarter(2).alias("middle")).collect()  # a row for each encoding
    found = {r.encoding: (r.n / (r.n + PRIOR), (r.middle + 0.5) * BIN, (r.middle - r.low) * BIN / 0.6745) for r in rows}
    seen = [found.get(k, (0.0, 0.0, 1.0)) for k in range(len(ENCODINGS))]
    return tuple((w * middle, max(1.0, w * spread + 1 - w)) for w, middle, spread in seen)


def _cut(docs: DataFrame, rate: float) -> Cut | None:
    """What is a discovery over all tokens of ``docs``; None where there is no token."""
    taken = F.concat(*[F.col(k) for k in KINDS[:3]])
    tokens = docs.select(F.explode(_candidates(F.col("text"), taken)).alias("c")).select("c.n", "c.encoding", "c.bin")
    # by length and score: the mean length and the null are known only at the end
    binned = Scratch(docs.sparkSession, "secrets").table(tokens.groupBy("encoding", "n", "bin").agg(F.count("*").alias("count")), "binned")
    total = binned.agg(F.sum("count").alias("tokens"), F.sum(F.col("n") * F.col("count")).alias("chars")).first()
    if not total.tokens:
        return None
    cut = Cut(fitted_null(binned), total.chars / total.tokens, None)
    levels = binned.groupBy(cut.level(F.col("encoding"), F.col("bin"), F.col("n")).alias("level")).agg(F.sum("count").alias("count"))
    # a row for each level; a level is met when the expected false discoveries are few beside those found
    found = levels.withColumn("above", F.sum("count").over(W.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)))
    met = found.where(F.pow(F.lit(10.0), -F.col("level") * BIN) * float(total.tokens) <= F.col("above") * rate)
    return Cut(cut.null, cut.mean, met.agg(F.min("level").alias("level")).first().level)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` (text and any other columns) with ``secret_spans``: array<struct<start, kind, end>>, by start and kind.

    Starts and ends count code points, ends exclusive; kind is the place in KINDS. Null texts count as empty, which
    have no spans. Repeated rows and ties get the same spans. A column ``secret_spans`` of ``docs`` is replaced. An
    empty table, or one without tokens for the battery, has spans of the base kinds only. Very long texts, and texts
    with thousands of spans, take time in proportion to their length, but for a scan of the text for each BLOCK spans.
    """
    based = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind, spans in _base(F.col("text")).items():
        based = based.withColumn(kind, spans)
    cut = _cut(based, rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*_base(text).values())
    out = docs.withColumn("secret_spans", base)
    if cut and cut.least is not None:
        # binned as in the histogram, so that a token's level is the same in both passes
        told = F.filter(_candidates(text, F.col("secret_spans")), lambda c: cut.level(c["encoding"], c["bin"], c["n"]) >= cut.least)
        added = F.transform(told, lambda c: c["span"])
        # a part of a run that is a discovery as a whole adds nothing
        inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o != s)
        whole = _once(added, lambda every: F.filter(every, lambda s: ~F.exists(every, lambda o: inside(s, o))))
        out = out.withColumn("secret_spans", F.concat("secret_spans", whole))
    return out.withColumn("secret_spans", F.array_sort("secret_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with an asterisk for each character of its ``spans``, by start; overlaps are masked once."""

    def block(acc: Column, own: Column) -> Column:
        """The text up to the end of a block of spans; ``acc`` has what was done before."""
        end = F.greatest(acc["to"], F.array_max(F.transform(own, lambda s: s["end"])))
        # the stretch is cut out of the text once, and pieces then out of the stretch
        told = lambda stretch: F.aggregate(
            own, F.struct(acc["to"].alias("to"), F.array().cast("array<string>").alias("out")),
            lambda x, s: F.when(s["end"] <= x["to"], x).otherwise(F.struct(s["end"].alias("to"), F.concat(x["out"], F.array(
                F.substring(stretch, x["to"] - acc["to"] + 1, F.greatest(s["start"] - x["to"], F.lit(0))),
                F.repeat(F.lit("*"), s["end"] - F.greatest(s["start"], x["to"])),
            )).alias("out"))),
            lambda x: F.array_join(x["out"], ""),
        )
        new = F.array_join(F.transform(F.array(F.substring(text, acc["to"] + 1, end - acc["to"])), told), "")
        return F.struct(end.alias("to"), F.concat(acc["out"], F.array(new)).alias("out"))

    zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("out"))
    done = lambda items: F.aggregate(_blocks(items), zero, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["to"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.array(spans), done), ""))


def cleaned(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with an asterisk for each character of a secret; other columns stay, whatever they are named."""
    spans = F.col("secret_spans")
    new = F.when(F.size(spans) > 0, masked(F.col("text"), spans)).otherwise(F.col("text"))
    if "secret_spans" not in docs.columns:
        return scan(docs, rate).withColumn("text", new).select(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.withColumnRenamed("secret_spans", "__secret_spans")
    return cleaned(held, rate).withColumnRenamed("__secret_spans", "secret_spans")
