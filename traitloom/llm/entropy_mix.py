"""Mixing sources to target weights by entropy balancing.

Document rates r are sought that meet token constraints while staying as close
as possible to 1 in Kullback-Leibler divergence over tokens.  Sources must meet
their targets; length classes should keep their shares of the corpus (a soft
constraint, with a quadratic price), so that the mix is not paid for by one
kind of document.  The dual of that problem is convex; its solution tilts rates
exponentially, r = min(most, exp(multiplier of the source + multiplier of the
length class)).

Newton iterations solve the dual jointly.  The sums depend on a document only
through its source and class, so they are taken over one row per source with
the words of its classes.  Every iteration is one distributed aggregation: the
sources' block of the Hessian is diagonal and is eliminated row by row, what is
left (the Schur complement) is a matrix of the few classes, which the driver
solves; the sources' steps follow row by row.  Steps are shortened until the
dual falls.

Rates become copies without drift: all documents get the whole part of their
rate, the rest of it is handed out as further copies from the longest documents
of a source to the shortest, always as many as bring the running words nearest
to what the rates want; ties go in order of a hash of the id.
"""

from __future__ import annotations

from itertools import product
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, fresh, numbered

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document and no source is repeated more often than this.
MOST = 3
#: Length classes: sizes below 3, 15, 63, ... words, the last one open.
CLASSES = 8
#: Relative gap of a length class that costs as much as a multiplier of 1.
SOFT = 0.1
#: Combinations of values that all margins but the first may have.
_COMBINATIONS = 64
#: Multiplier of a value that takes as much as it may; no other outweighs it.
_HELD = 40.0
#: Documents of one source and size that one task ranks together, about.
_RANKED = 64
_SALTS = 4096


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_class(size: Column) -> Column:
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(size + 1) / 2)).cast("int")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words per source from ``sources(source, source_size)``, one row per source.

    The total is shared by weight; a target above ``most`` times its source is
    held there and the excess reshared by weight.  The level (target per unit
    of weight) only rises while sources are held, so it is found by repeating
    one aggregation until no further source is.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "_rank")
    rows = cut(ranked.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * float(most)).alias("_cap")))
    all_words, all_weights = rows.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, held = (all_words or 0) / (all_weights or 1.0), -1
    while True:
        over = F.col("_weight") * level > F.col("_cap")
        n, words, used = rows.where(over).agg(F.count("*"), F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
        if n == held or used >= (all_weights or 0):
            break
        level, held = (all_words - words) / (all_weights - used), n
    return rows.select("source", "source_size", F.least("_cap", F.col("_weight") * level).alias("target"))


class _Dual:
    """The dual over one row per value of the first margin and the combinations of all others."""

    def __init__(self, most: float, tied: np.ndarray, targets: np.ndarray, price: np.ndarray):
        self.most, self.tied, self.targets, self.price = most, tied, targets, price

    def tilted(self, state: DataFrame, mu: np.ndarray, step: float) -> DataFrame:
        """The rows at ``multiplier + step * direction``: taken and curving words per combination, and their sums."""
        at = F.col("multiplier") + step * F.col("direction")
        theta = [at + float(t) for t in self.tied @ mu]
        top = log(self.most)
        size = [F.get("words", F.lit(i)) for i in range(len(theta))]
        curved = F.array(*[w * F.when(t < top, F.exp(t)).otherwise(0.0) for w, t in zip(size, theta, strict=True)])
        taken = F.array(*[w * F.when(t < top, F.exp(t)).otherwise(float(self.most)) for w, t in zip(size, theta, strict=True)])
        value = F.array(*[w * F.when(t < top, F.exp(t)).otherwise(self.most * (t + 1 - top)) for w, t in zip(size, theta, strict=True)])
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        rows = state.select("value", "target", "held", at.alias("multiplier"), "words", curved.alias("curved"), taken.alias("taken"), total(value).alias("dual"))
        free = ~F.col("held")
        gap = F.when(free, total("taken") - F.col("target")).otherwise(0.0)
        return rows.withColumns({"gap": gap, "bend": F.when(free, total("curved")).otherwise(0.0), "dual": F.when(free, F.col("dual") - F.col("target") * F.col("multiplier")).otherwise(0.0)})

    def sums(self, rows: DataFrame, mu: np.ndarray) -> dict:
        """Dual, gaps and Schur complement at the given rows, by one aggregation."""
        n = len(self.tied)
        live = F.col("bend") > 0
        c = [F.when(~F.col("held"), F.get("curved", F.lit(i))).otherwise(0.0) for i in range(n)]
        out = [F.sum("dual").alias("dual"), F.max(F.abs("gap") / F.greatest("target", F.lit(1.0))).alias("off")]
        out += [F.sum(F.get("taken", F.lit(i))).alias(f"t{i}") for i in range(n)]
        out += [F.sum(F.when(~F.col("held"), 0.0).otherwise(F.get("taken", F.lit(i)))).alias(f"f{i}") for i in range(n)]
        out += [F.sum(c[i]).alias(f"c{i}") for i in range(n)]
        out += [F.sum(F.when(live, c[i] * F.col("gap") / F.col("bend")).otherwise(0.0)).alias(f"g{i}") for i in range(n)]
        out += [F.sum(F.when(live, c[i] * c[j] / F.col("bend")).otherwise(0.0)).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
        row = rows.agg(*out).first()
        if row["dual"] is None:
            return {"dual": 0.0, "off": 0.0, "gradient": np.zeros(len(mu)), "hessian": np.zeros((len(mu),) * 2), "pull": np.zeros(len(mu))}
        schur = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        pick = lambda k: np.array([row[f"{k}{i}"] for i in range(n)])
        return {
            "dual": row["dual"] + float(pick("f") @ (self.tied @ mu)) - float(self.targets @ mu) + float(self.price @ mu**2) / 2,
            "off": row["off"],
            "gradient": self.tied.T @ pick("t") - self.targets + self.price * mu,
            "hessian": self.tied.T @ (np.diag(pick("c")) - schur) @ self.tied + np.diag(self.price),
            "pull": self.tied.T @ pick("g"),
        }

    def directions(self, rows: DataFrame, move: np.ndarray) -> DataFrame:
        """The Newton direction of every row of the first margin, given that of the others; at most one unit."""
        pulled = F.col("gap")
        for i, m in enumerate(self.tied @ move):
            pulled = pulled + F.get("curved", F.lit(i)) * float(m)
        step = F.when(F.col("held"), 0.0).when(F.col("bend") > 0, -pulled / F.col("bend")).otherwise(-F.signum("gap"))
        return rows.select("value", "target", "held", "multiplier", "words", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)).alias("direction"))


def balance(cells: DataFrame, names: list[str], targets: dict[str, DataFrame], most: float = MOST, rounds: int = 60, near: float = 1e-9, soft: float | None = None) -> DataFrame:
    """Multipliers that meet every constraint: a table (name, value, multiplier).

    ``cells`` has the columns ``names`` and words; ``targets[name]`` has (name's
    value as ``value``, target).  Rates exp(sum of multipliers) stop at
    ``most``.  The first margin may have any number of values; its constraints
    are met to a relative gap below ``near``.  The combinations of the values
    of all others are at most 64.  With ``soft`` these others are no hard
    constraints: a relative gap of ``soft`` costs a multiplier of 1.

    A value without words, or whose target is 0, keeps the multiplier 0; one
    whose target is all that it may take gets a multiplier beyond all others.
    Null values are values.  ValueError if ``rounds`` iterations do not solve
    it, as where hard constraints contradict each other.
    """
    first, others = names[0], names[1:]
    known = [[(r["value"], float(r["target"])) for r in targets[name].select(F.col("value").cast("string").alias("value"), "target").collect()] for name in others]
    combinations = list(product(*[[v for v, _ in values] for values in known]))
    if len(combinations) > _COMBINATIONS:
        raise ValueError(f"margins after the first have over {_COMBINATIONS} combinations of values")
    index = {(name, value): None for name, values in zip(others, known, strict=True) for value, _ in values}
    index = {key: i for i, key in enumerate(index)}
    tied = np.zeros((len(combinations), len(index)))
    for i, combination in enumerate(combinations):
        for name, value in zip(others, combination, strict=True):
            tied[i, index[name, value]] = 1
    wanted = np.array([t for values in known for _, t in values])
    dual = _Dual(most, tied, wanted, wanted * soft if soft else np.zeros(len(wanted)))

    of = [F.sum(F.when(_all(F.col(n).cast("string").eqNullSafe(F.lit(v)) for n, v in zip(others, c, strict=True)), F.col("words")).otherwise(0.0)).cast("double") for c in combinations]
    words = cells.groupBy(F.col(first).cast("string").alias("_value")).agg(F.array(*of).alias("words"), F.sum("words").cast("double").alias("_size"))
    mine = targets[first].select(F.col("value").cast("string").alias("value"), F.col("target").cast("double").alias("target"))
    state = mine.join(words, F.col("value").eqNullSafe(F.col("_value")), "left")
    size = F.coalesce("_size", F.lit(0.0))
    full = (size > 0) & (F.col("target") >= most * size * (1 - 1e-12))
    idle = (size == 0) | (F.col("target") == 0)
    begin = F.when(full, _HELD).when(idle, 0.0).otherwise(F.log(F.col("target") / F.greatest(size, F.lit(1e-300))))
    blank = F.array(*[F.lit(0.0)] * len(combinations))
    state = cut(state.select("value", "target", (full | idle).alias("held"), begin.alias("multiplier"), F.when(idle, blank).otherwise(F.col("words")).alias("words"), F.lit(0.0).alias("direction")))

    mu = np.zeros(len(index))
    rows = dual.tilted(state, mu, 0.0)
    now = dual.sums(rows, mu)
    total = max(1.0, float(wanted.sum()))
    for _ in range(rounds):
        if now["off"] < near and (not len(mu) or np.abs(now["gradient"]).max() < near * total):
            break
        move = np.zeros(len(mu))
        if len(mu):
            move = np.linalg.lstsq(now["hessian"], now["pull"] - now["gradient"], rcond=1e-12)[0]
            move *= min(1.0, 1 / max(1e-300, np.abs(move).max()))
        for joint in (True, False):  # where no joint step lowers the dual, the first margin moves alone
            move = move if joint else np.zeros(len(mu))
            moving = cut(dual.directions(rows, move))
            step = 1.0
            while True:
                ahead = dual.tilted(moving, mu + step * move, step)
                then = dual.sums(ahead, mu + step * move)
                if then["dual"] <= now["dual"] + 1e-13 * abs(now["dual"]) or step < 1e-3:
                    break
                step /= 2
            if step >= 1e-3:
                break
        mu, rows, now = mu + step * move, ahead, then
    else:
        raise ValueError(f"not balanced in {rounds} rounds: a gap of {now['off']:.2g} is left")
    out = rows.select(F.lit(first).alias("name"), "value", "multiplier")
    session = cells.sparkSession
    if index:
        out = out.unionAll(session.createDataFrame([(name, value, float(m)) for (name, value), m in zip(index, mu, strict=True)], "name string, value string, multiplier double"))
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _extra(most: float):
    """How many documents of each (size, rate) cell of one source get a copy more than the whole part of their rate."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        owed, more = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            whole = int(rate)
            owed += (rate - whole) * n * size
            k = round(owed / size) if size else round((rate - whole) * n)
            k = min(max(k, 0), n if whole + 1 <= most else 0)
            owed -= k * size
            more.append(k)
        return cells.assign(more=more)[["source", "size", "n", "more"]]

    return run


def _copies(rows: DataFrame, most: float) -> DataFrame:
    """Copies from rates by cumulative rounding of words.

    ``rows`` has source, size, rate (one per source and size), ticket (a
    uniform number in [0, 1)) and further columns.  Documents of one source and
    size are a cell; a source has at most as many cells as its longest document
    has words, and these are walked together.  Within a cell the documents with
    the smallest tickets get the cell's further copies, ranked in salted parts.
    """
    cell = ["source", "size"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    cells = cells.groupBy("source").applyInPandas(_extra(most), "source string, size long, n long, more long")
    salts = F.greatest(F.lit(1), F.least(F.lit(_SALTS), F.ceil(F.col("n") / _RANKED))).cast("int")
    cells = cut(cells.select(*cell, "more", salts.alias("salts")))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cell]
    salted = rows.alias("r").join(cells.alias("c"), same[0] & same[1]).select("r.*", "more", "salts").withColumn("salt", F.floor(F.col("ticket") * F.col("salts")).cast("int"))
    salted = cut(salted)
    parts = salted.groupBy(*cell, "salt").agg(F.count("*").alias("m"), F.first("more").alias("more"))
    ahead = F.coalesce(F.sum("m").over(W.partitionBy(*cell).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*cell, "salt", F.greatest(F.lit(0), F.col("more") - ahead).alias("quota"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy(*cell, "salt").orderBy("ticket")))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*cell, "salt")]
    done = ranked.alias("r").join(parts.alias("p"), same[0] & same[1] & same[2]).select("r.*", "quota")
    return done.withColumn("copies", (F.floor("rate") + (F.col("rank") <= F.col("quota")).cast("int")).cast("int")).drop("more", "salts", "salt", "rank", "quota", "ticket")


def _key(docs: DataFrame) -> dict[str, Column]:
    """What tells the rows of a documents table apart here: id, source and a hash of id and text."""
    return {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "hash": F.xxhash64(F.col("doc_id").cast("long"), "text")}


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, soft: float = SOFT) -> DataFrame:
    """Copies of every document such that sources reach their targets.

    ``docs`` needs doc_id, text and source; other columns are ignored.  Result
    per row: doc_id, source, size, hash, source_size, target, rate, copies,
    taken (copies times size).  taken never exceeds ``most`` times size and a
    source's sum misses its target by no more than the size of its shortest
    documents that can take a copy more.

    Null and wordless texts have size 0, take nothing and get copies by their
    rate all the same.  Null is a source of its own, ordered last.  Rows that
    repeat a doc_id are rounded each on its own; equal rows may swap their
    copies between runs, the table as a whole does not change.  A source
    without words has target 0.  An empty table gives an empty result.
    """
    key = _key(docs)
    rows = cut(docs.select(key["doc_id"].alias("doc_id"), key["source"].alias("source"), size_of(F.col("text")).alias("size"), key["hash"].alias("hash")))
    cells = cut(rows.groupBy("source", length_class(F.col("size")).alias("length")).agg(F.sum("size").alias("words")))
    wanted = cut(source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    lengths = cells.where("words > 0").groupBy(F.col("length").alias("value")).agg(F.sum("words").alias("target"))
    solved = cut(balance(cells, ["source", "length"], {"source": wanted.select(F.col("source").alias("value"), "target"), "length": lengths}, most, soft=soft))
    tilts = {int(r["value"]): r["multiplier"] for r in solved.where("name = 'length'").collect()}
    tilt = F.get(F.array(*[F.lit(tilts.get(i, 0.0)) for i in range(CLASSES)]), length_class(F.col("size")))
    sources = cut(wanted.join(solved.where("name = 'source'"), F.col("source").eqNullSafe(F.col("value"))).select("source", "source_size", "target", "multiplier"))
    rate = F.least(F.lit(float(most)), F.exp(F.col("multiplier") + tilt))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    ticket = F.pmod("hash", F.lit(1 << 52)) / F.lit(float(1 << 52))
    rated = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "d.source", "size", "hash", ticket.alias("ticket"), "source_size", "target", rate.alias("rate"))
    return _copies(rated, most).withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST, soft: float = SOFT) -> DataFrame:
    """``docs`` with every row repeated as often as :func:`mix` says, or left out.

    Columns, whatever their names, stay as they are.  Rows of equal id, source
    and text share the copies that they have together: each gets the whole
    part, and the first of them, numbered per partition, one more.  So a key
    that many rows share is never brought to one task.
    """
    key = _key(docs)
    own = dict(zip(key, fresh(docs, "id_", "source_", "hash_"), strict=True))
    rows_, copies_, part, nth, before, here, copy = fresh(docs, "rows_", "copies_", "part_", "nth_", "before_", "here_", "copy_")
    groups = mix(docs, weights, most, soft).groupBy(*key).agg(F.count("*").alias(rows_), F.sum("copies").alias(copies_)).where(F.col(copies_) > 0)
    groups = cut(groups.withColumnsRenamed({k: f"{own[k]}g" for k in key}))  # written, so that the rows of a hot key can be split
    keyed = docs.withColumns({own[k]: c for k, c in key.items()})
    met = keyed.join(groups, _all(F.col(own[k]).eqNullSafe(F.col(f"{own[k]}g")) for k in key))
    each, rest = F.floor(F.col(copies_) / F.col(rows_)).cast("int"), F.col(copies_) % F.col(rows_)
    even = met.where(rest == 0).select(*_columns(docs), F.explode(F.sequence(F.lit(1), each)).alias(copy))

    odd = cut(met.where(rest > 0)).withColumn(part, F.spark_partition_id())
    parts = odd.groupBy(*own.values(), part).agg(F.count("*").alias(here))
    ahead = F.sum(here).over(W.partitionBy(*own.values()).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    parts = cut(parts.select(*[F.col(c).alias(f"{c}p") for c in (*own.values(), part)], F.coalesce(ahead, F.lit(0)).alias(before)))
    ranked = odd.withColumn(nth, F.row_number().over(W.partitionBy(*own.values(), part).orderBy(own["hash"])))
    placed = ranked.join(parts, _all(F.col(c).eqNullSafe(F.col(f"{c}p")) for c in (*own.values(), part)))
    n = each + (F.col(before) + F.col(nth) <= rest).cast("int")
    some = placed.where(n > 0).select(*_columns(docs), F.explode(F.sequence(F.lit(1), n)).alias(copy))
    return even.unionAll(some).drop(copy)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]
