"""Quality rules: a decision list learned by sequential covering.

Every text gets statistics: its words, their characters, symbols, repeated
lines, words in repeated windows, and shares of these.  From labelled rows,
rules are learned one after another.  A rule is a conjunction of thresholds on
statistics: it grows literal by literal, each the one of highest information
gain on two thirds of the rows, and is then pruned, last literals first, by its
worth on the other third.  Rows that it covers leave, and the next rule is
learned from what is left, until no rule is precise enough.  The list becomes
one ordered conditional expression over the statistics.

Everything is DataFrame functions.  A growth step is one aggregation of all
labelled rows; only counts per (statistic, cell) reach the driver, and there are
at most ``CELLS`` cells per statistic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh

#: Quantiles per statistic, over all labelled rows, between which thresholds lie.
CELLS = 64
#: Words of a window whose repetition counts; a power of two.
WINDOW = 8
_WORD = r"[^\x20\x09-\x0D]+"
#: Counts that :func:`measured` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _following(items: Column, last: Column) -> Column:
    """Each item's successor; ``last`` follows the last one."""
    return F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), F.array(last))


def _windows(words: Column) -> Column:
    """Hashes of all windows of ``WINDOW`` words, each from the hashes of its halves."""

    def doubled(size):
        def run(h):
            return F.zip_with(h, F.slice(h, F.lit(size + 1), F.greatest(F.size(h) - size, F.lit(0))), lambda a, b: F.xxhash64(a, b))

        return run

    hashes, size = F.transform(words, lambda w: F.xxhash64(w)), 1
    while size < WINDOW:
        hashes, size = _bound(hashes, doubled(size)), 2 * size
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))


def _repeated(windows: Column) -> Column:
    """Words that windows found twice or more cover, from the windows' hashes in order of place."""

    def places(found):
        """Places of windows beside an equal one, where ``found`` has (hash, place) in order."""
        beside = F.zip_with(found, _following(found, F.lit(None).cast("struct<h:bigint,at:int>")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull()))))

    def covered(at):
        return F.aggregate(F.zip_with(at, _following(at, F.lit(2**31 - 1)), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda n, x: n + x)

    found = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    several = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(several, _bound(_bound(found, places), covered)).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` without its text and with the counts of ``COUNTS`` (long) of every whole text.

    Columns of these names are replaced.  Null texts have no words and no
    lines.  Windows are compared by 64-bit hashes of their words.
    """
    kept = [c for c in docs.columns if c not in (*COUNTS, "text")]
    text, words, windows = fresh(docs, "whole", "words", "windows")
    counted = lambda pattern: F.regexp_count(F.col(text), F.lit(pattern))
    base = docs.select(*kept, F.coalesce("text", F.lit("")).alias(text)).withColumn(words, F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    base = base.withColumn(windows, _windows(F.col(words)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(_WORD)))
    rows = base.select(
        *kept,
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        counted(r"[#*$%&|<>]").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias(text),
        _repeated(F.col(windows)).alias("n_repeat_words"),
        counted("[A-Z]").alias("n_capitals"),
        counted("[!?]").alias("n_marks"),
    )
    rows = rows.withColumns({"n_lines": F.col(text)["n"], "n_dup_lines": F.col(text)["again"]})
    return rows.select(*kept, *[F.col(c).cast("long").alias(c) for c in COUNTS])


def base_failed() -> Column:
    """The fixed rule on the counts: too few words, or too many in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """The statistics that rules are made of, from the counts; 0 where a text has no words."""
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_char": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "capitals_per_char": share("n_capitals", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Literal:
    """``name > bound`` where ``above``, else ``name <= bound``."""

    name: str
    above: bool
    bound: float

    def over(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.bound if self.above else stats[self.name] <= self.bound

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:.6g}"


def _all(literals: list[Literal], stats: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.over(stats) for x in literals], F.lit(True))


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    """Information gain of a literal that keeps p of all_p wanted and n of all_n other rows."""
    return p * (log2(p / (p + n)) - log2(all_p / (all_p + all_n))) if p else 0.0


def _best(counts: list, bounds: dict[str, list[float]], total: tuple[int, int]) -> tuple[float, Literal | None]:
    """The literal of highest gain; among equals the first by statistic, side and bound."""
    table = {(r["name"], r["cell"]): (r["p"], r["n"]) for r in counts}
    best, found = 0.0, None
    for name, cuts in bounds.items():
        p = n = 0
        for cell, bound in enumerate(cuts):  # cell i holds what is at most cuts[i] and above cuts[i - 1]
            more = table.get((name, cell), (0, 0))
            p, n = p + more[0], n + more[1]
            for above, kept in ((False, (p, n)), (True, (total[0] - p, total[1] - n))):
                gain = _gain(*kept, *total)
                if gain > best + 1e-9:
                    best, found = gain, Literal(name, above, bound)
    return best, found


def _between(values: list[float]) -> list[float]:
    """Midpoints of neighbouring values."""
    return [(a + b) / 2 for a, b in pairwise(values)]


def _cell(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < value))


def learn(labelled: DataFrame, precision: float = 0.95, least: int = 10, longest: int = 4) -> list[list[Literal]]:
    """A decision list for the rows to drop, from ``labelled``: doc_id, the counts and ``bad`` (boolean).

    A rule has up to ``longest`` literals, covers ``least`` wanted rows in both
    parts together, and reaches ``precision`` in both.  A literal's bound lies midway between
    neighbours among ``CELLS`` quantiles of its statistic.  Rows whose label is null teach nothing; without rows, or
    without rows of either kind, the list is empty.  A third of the rows, by a hash of doc_id,
    prunes and the others grow.
    """
    stats = statistics()
    names = list(stats)
    prunes = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(3)) == 0
    # equal counts become one weighted row on either side
    rows = labelled.where("bad is not null").groupBy(prunes.alias("prunes"), *COUNTS).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    rows = cut(rows.select("p", "n", "prunes", *[c.alias(k) for k, c in stats.items()]))
    asked = [F.percentile_approx(k, [i / CELLS for i in range(CELLS + 1)], 10_000).alias(k) for k in names]
    found = rows.agg(*asked).first()
    bounds = {k: _between(sorted(set(found[k] or []))) for k in names}
    cells = {k: _cell(F.col(k), bounds[k]) for k in names}
    rows = cut(rows.select("p", "n", "prunes", *names, *[c.alias(f"cell_{k}") for k, c in cells.items()]))
    here = {k: F.col(k) for k in names}
    listed: list[list[Literal]] = []
    while True:
        left = reduce(lambda a, rule: a & ~_all(rule, here), listed, F.lit(True))
        rule: list[Literal] = []
        while len(rule) < longest:
            now = rows.where(left & ~F.col("prunes") & _all(rule, here))
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"cell_{k}").alias("cell")) for k in names]))
            counts = now.select("p", "n", each.alias("x")).groupBy("x.name", "x.cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            total = tuple(sum(r[c] for r in counts if r["name"] == names[0]) for c in ("p", "n"))
            if not all(total):  # nothing to tell apart any more
                break
            _, literal = _best(counts, bounds, total)
            if literal is None or literal in rule:
                break
            rule.append(literal)
        if not rule:
            return listed
        rule = _pruned(rows.where(left), rule, here, precision, least)
        if not rule:
            return listed
        listed.append(rule)


def _pruned(rows: DataFrame, rule: list[Literal], here: dict[str, Column], precision: float, least: int) -> list[Literal]:
    """The beginning of the rule that is worth most on the pruning rows, if it is precise enough; else none."""
    sums = []
    for i in range(len(rule)):
        for part, side in (("grown", ~F.col("prunes")), ("held", F.col("prunes"))):
            covered = side & _all(rule[: i + 1], here)
            sums += [F.coalesce(F.sum(F.when(covered, F.col(c))), F.lit(0)).alias(f"{part}_{c}_{i}") for c in ("p", "n")]
    got = rows.agg(*sums).first()
    best, out = 0.0, []
    for i in range(len(rule)):
        p, n, gp, gn = (got[f"{part}_{c}_{i}"] for part in ("held", "grown") for c in ("p", "n"))
        if p + gp < least or p < precision * (p + n) or gp < precision * (gp + gn):
            continue
        worth = (p - n) / (p + n) if p + n else 0.0
        if not out or worth > best:
            best, out = worth, rule[: i + 1]
    return out


def as_column(listed: list[list[Literal]]) -> Column:
    """The list as one ordered conditional expression over the counts: the text of the first rule that fits, else null."""
    stats = statistics()
    out = F.lit(None).cast("string")
    for rule in reversed(listed):
        out = F.when(_all(rule, stats), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, precision: float = 0.95, least: int = 10) -> DataFrame:
    """Verdict on every document by the base rule and by a list learned from ``labels(doc_id, quality)``.

    ``docs`` needs doc_id and text; its other columns are kept, but for those of
    the names added: the counts of ``COUNTS``, base_failed, rule (the first
    learned rule that fits, else null) and kept (neither failed).

    A label is bad where quality is 0; null labels and labels of unknown
    documents teach nothing, a doc_id with several labels has its lowest, and
    documents with a null doc_id are judged but not learned from.  Repeated rows
    are judged alike.  Null and empty texts have no words and fail.  Without
    labels there is no learned rule.  An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in (*COUNTS, "text", "base_failed", "rule", "kept")]
    counts = cut(measured(docs.select(*kept, "text")))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    listed = learn(counts.where(~base_failed()).select("doc_id", *COUNTS).join(cut(known), "doc_id"), precision, least)
    judged = counts.withColumns({"base_failed": base_failed(), "rule": as_column(listed)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
