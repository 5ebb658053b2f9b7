"""Secret spans: fixed patterns, and character Markov models for random strings.

Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, are trained from labelled samples of the corpus: the
values that the fixed patterns find are random, stretches of letters, digits
and joining signs outside of them are ordinary.  Both are smoothed towards the
uniform distribution, the random one strongly, because a secret may use
characters that the found ones lack.  A run outside the fixed patterns is a
secret where the log-likelihood ratio per transition exceeds a threshold that
is fitted on labelled strings which the models were not trained on.
Everything runs as DataFrame functions: the counts are one aggregation, the
model is an array of fixed size.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

# The base patterns, in listed order, and the least length of
# what they must have matched (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: What stands before an assigned value: the last letter of a name, and the sign.
_BEFORE_VALUE = r"""[dDtTnNyY]["']?\x20*[:=]"""
#: Characters of the models; a run is a stretch of these.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_CLASS = "[A-Za-z0-9+/_-]"
#: Runs are judged from this length on.
RUN_LEAST = 12
#: Share of the uniform distribution in the models of random and of ordinary strings.
UNIFORM = (0.5, 0.02)
#: Threshold where no labelled samples could fit one.
THRESHOLD = 0.7
#: Elements that one step of a scan over an array holds, so that it stays linear.
_BLOCK = 256
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(items: Column, i: Column) -> Column:
    return F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK))


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches of ``pattern`` as structs (start, kind, end, value), failing ones dropped.

    The pieces between the matches give their places: match i starts after the
    first i + 1 pieces and the first i matches.  Running places are summed by
    blocks, so the work grows in proportion to the matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    match = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("size"), v.alias("value")))
    parts = F.zip_with(F.split(text, pattern, -1), match, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(m["size"], F.lit(0)).alias("size"), m["value"].alias("value")))
    empty = F.array().cast(_SPAN)

    def in_block(items, at):
        def step(state, part):
            begin = state["at"] + part["gap"]
            end = begin + part["size"]
            hit = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), part["value"].alias("value"))
            good = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
            out = F.when(good, F.concat(state["out"], F.array(hit))).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        return F.aggregate(items, F.struct(at.alias("at"), empty.alias("out")), step)["out"]

    def placed(items):
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
        sizes = F.transform(blocks, lambda i: F.aggregate(_block(items, i), F.lit(0), lambda at, p: at + p["gap"] + p["size"]))
        offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.get(out, F.size(out) - 1) + n)))
        return _let(offsets, lambda at: F.flatten(F.transform(blocks, lambda i: in_block(_block(items, i), F.get(at, i)))))

    return _let(parts, placed)


def _runs(text: Column) -> Column:
    """Stretches of at least ``RUN_LEAST`` characters of the alphabet, in order."""
    return F.regexp_extract_all(text, F.lit(_run(RUN_LEAST)), F.lit(0))


def _base(text: Column, runs: Column) -> Column:
    """Spans of the fixed patterns, by kind, in a text whose :func:`_runs` are given.

    A hexadecimal or access run is a greedy match of one character class, so
    asking for the least length in the pattern finds the same runs.  As each
    lies within one run of the alphabet, only texts with a run that holds one
    are searched; most texts skip the costly part.
    """
    long_access, long_hex = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"[0-9a-f]{{{LEAST['hex']},}}"
    held = lambda pattern: F.exists(runs, lambda r: F.regexp_like(r, F.lit(pattern)))
    assigned = F.regexp_like(text, F.lit(_BEFORE_VALUE)) & F.regexp_like(text, F.lit(ASSIGN))
    found = (
        (assigned, _spans(text, "assign", ASSIGN, 2, LEAST["assign"])),
        (held(long_access), _spans(text, "access", long_access, 0, LEAST["access"])),
        (held(long_hex), _spans(text, "hex", long_hex, 0, LEAST["hex"])),
    )
    return F.concat(*[F.when(here, spans).otherwise(F.array().cast(_SPAN)) for here, spans in found])


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind."""
    return _let(_runs(text), lambda runs: _base(text, runs))


def _masked(text: Column) -> Column:
    """``text`` with what the fixed patterns find blanked out, place by place."""
    union = f"{ASSIGN[:-2]}{{{LEAST['assign']},}})|AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}|[0-9a-f]{{{LEAST['hex']},}}"
    found = F.transform(F.regexp_extract_all(text, F.lit(union), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    pieces = F.zip_with(F.split(text, union, -1), found, lambda gap, blank: F.concat(gap, F.coalesce(blank, F.lit(""))))
    return F.array_join(pieces, "")


def _run(least: int) -> str:
    """A whole stretch of at least ``least`` characters of the alphabet."""
    return f"(?<!{_CLASS}){_CLASS}{{{least},}}"


def _labelled(docs: DataFrame, max_rows: int) -> DataFrame:
    """Distinct labelled strings (label 1 random, 0 ordinary; s; n times) of about ``max_rows`` rows, picked by hash."""
    rows = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows))) < max_rows)
    picked = picked.select(F.coalesce("text", F.lit("")).alias("text")).select("text", base_spans(F.col("text")).alias("base"))
    random = F.transform("base", lambda b: F.struct(F.lit(1).alias("label"), b["value"].alias("s")))
    ordinary = F.transform(F.regexp_extract_all(F.when(F.size("base") > 0, _masked(F.col("text"))).otherwise(F.col("text")), F.lit(_run(8)), F.lit(0)), lambda s: F.struct(F.lit(0).alias("label"), s.alias("s")))
    return picked.select(F.explode(F.concat(random, ordinary)).alias("x")).select("x.*").where(F.length("s") > 1).groupBy("label", "s").agg(F.count("*").alias("n"))


def _table(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every character pair, first character major."""
    chars = F.split("s", "")
    pair = F.explode(_let(chars, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))).alias("pair")
    counted = strings.select("label", "n", pair).groupBy("label", "pair").agg(F.sum("n").alias("n"))
    n = {(r["label"], r["pair"]): r["n"] for r in counted.collect()}
    size = len(ALPHABET)

    def conditional(label, share):
        """P(b | a), with few counts drawn to the label's frequency of b, and mixed with the uniform distribution."""
        into = {b: sum(n.get((label, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
        every = sum(into.values())
        out = {}
        for a in ALPHABET:
            total = sum(n.get((label, a + b), 0) for b in ALPHABET)
            for b in ALPHABET:
                seen = (n.get((label, a + b), 0) + 8 * into[b] / every) / (total + 8)
                out[a + b] = (1 - share) * seen + share / size
        return out

    ordinary, random = (conditional(label, UNIFORM[1 - label]) for label in (0, 1))
    return [log(random[a + b] / ordinary[a + b]) for a in ALPHABET for b in ALPHABET]


def train(docs: DataFrame, max_rows: int = 5000) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every character pair, first character major.

    Labelled samples come from about ``max_rows`` rows of ``docs`` (doc_id,
    text).  Random: the values that the fixed patterns find; where there are
    none, the uniform distribution alone.  Ordinary: stretches of eight or more
    characters of the alphabet outside of them.  At most two counts per
    character pair of what the patterns can match reach the driver.
    """
    return _table(_labelled(docs, max_rows))


def learn(docs: DataFrame, max_rows: int = 5000) -> tuple[list[float], float]:
    """The table that :func:`train` describes, from half of the labelled strings, and a threshold from the other half.

    The threshold is the ratio at which the share of random strings below plus
    a hundred times the share of ordinary strings above is least; of equally
    good ones (steps of 0.05) the middle one.  ``THRESHOLD`` where either
    label has no string.
    """
    strings = cut(_labelled(docs, max_rows).withColumn("half", F.pmod(F.xxhash64("s"), F.lit(2))))
    table = _table(strings.where("half = 0"))
    judged = strings.where((F.col("half") == 1) & (F.length("s") >= RUN_LEAST))
    bins = judged.groupBy("label", F.floor(likelihood_ratio(F.col("s"), table) * 20).alias("bin")).agg(F.sum("n").alias("n")).collect()
    n = {(r["label"], r["bin"]): r["n"] for r in bins}
    totals = [sum(c for (label, _), c in n.items() if label == k) for k in (0, 1)]
    if not all(totals):
        return table, THRESHOLD
    places = range(min(b for _, b in n), max(b for _, b in n) + 2)
    cost = {at: sum(c for (label, b), c in n.items() if label == 1 and b < at) / totals[1] + 100 * sum(c for (label, b), c in n.items() if label == 0 and b >= at) / totals[0] for at in places}
    best = [at for at in places if cost[at] == min(cost.values())]
    return table, best[len(best) // 2] / 20


def _constant(values, kind: str) -> Column:
    """Numbers as one constant array, which costs the driver one expression instead of one per number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def likelihood_ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string; characters outside the alphabet are passed over."""
    model = _constant([round(x, 6) for x in table], "double")
    place = _constant([ALPHABET.find(chr(i)) for i in range(128)], "int")
    codes = F.transform(F.split(value, ""), lambda c: F.coalesce(F.get(place, F.ascii(c)), F.lit(-1)))
    codes = F.filter(codes, lambda c: c >= 0)
    size = len(ALPHABET)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(state, code):
        gain = F.when(state["last"] < 0, F.lit(0.0)).otherwise(F.get(model, state["last"] * size + code))
        return F.struct(code.alias("last"), (state["sum"] + gain).alias("sum"))

    return F.aggregate(codes, start, step)["sum"] / F.greatest(F.length(value) - 1, F.lit(1))


def _random(text: Column, runs: Column, base: Column, table: list[float], threshold: float) -> Column:
    """Runs outside the base spans whose ratio exceeds ``threshold``.

    Each distinct run is scored once; places are only sought where one is a
    secret, and runs are only sought again where base spans have been blanked.
    """
    apart = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    bare = F.size(base) == 0

    def placed(secrets):
        rest = F.when(bare, text).otherwise(_masked(text))
        found = F.filter(_spans(rest, "markov", _run(RUN_LEAST)), lambda r: F.array_contains(secrets, r["value"]) & apart(r))
        return F.when(F.size(secrets) > 0, found).otherwise(F.array().cast(_SPAN))

    judged = F.array_distinct(F.when(bare, runs).otherwise(_runs(_masked(text))))
    return _let(F.filter(judged, lambda r: likelihood_ratio(r, table) > threshold), placed)


def _both(text: Column, table: list[float], threshold: float) -> Column:
    """``base`` and ``spans`` of a text, each in order of start and then kind; its runs are sought once."""

    def found(runs):
        return _let(F.array_sort(_base(text, runs)), lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, _random(text, runs, base, table, threshold))).alias("spans")))

    return _let(_runs(text), found)


def all_spans(text: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """All spans of a text, base ones and random runs, in order of start and then kind."""
    return _both(F.coalesce(text, F.lit("")), table, threshold)["spans"]


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float | None = None) -> DataFrame:
    """All secret spans of every text.

    ``docs`` needs ``doc_id`` and ``text``; its other columns are kept, except
    that base and spans are replaced.  Adds base and spans: arrays of structs
    (start, kind, end, value) in order of start and then kind, an index into
    ``KINDS``; places count code points from 0, ends are exclusive.  ``table``
    is what :func:`train` returns; without it, table and threshold are learned
    from ``docs``.  A run of ``RUN_LEAST`` or more characters of the alphabet
    outside the base spans is added as a markov span where its mean ratio
    exceeds the threshold.

    Null and empty texts have no spans.  Repeated rows and null ids are scanned
    like others.  An empty table gives an empty result.
    """
    if table is None:
        table, fitted = learn(docs.select("doc_id", "text"))
        threshold = fitted if threshold is None else threshold
    threshold = THRESHOLD if threshold is None else threshold
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("spans", _both(text, table, threshold))
    return found.withColumns({"base": F.col("spans")["base"], "spans": F.col("spans")["spans"]})


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (sorted; overlaps allowed) replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        put = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit(mark)).alias("out"))
        more = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], put).otherwise(more)

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))).otherwise(text)
