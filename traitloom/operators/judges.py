"""Evaluation aggregates that are fed rows and merge: counts, and places of points."""

from __future__ import annotations

from math import sqrt

import pyarrow as pa
import pyarrow.compute as pc

from traitloom.operators.extension import Aggregator


def _sums(table: pa.Table) -> dict:
    return {c: pc.sum(table[c]).as_py() or 0 for c in table.column_names}


def _over(a: float, b: float) -> float | None:
    return a / b if b else None


class CountJudge(Aggregator):
    """Errors of predicted counts (``n``) against true ones (``m``); a truth of 0 counts its error in full percent.

    Rows with a null on either side teach nothing.
    """

    state = "k long, e double, ae double, pe double, ape double, ee double, t double, tt double, p double, pp double, tp double"
    result = "me double, mae double, mpe double, mape double, mse double, r double, r2 double, rmse double"

    def reduce(self, rows: pa.Table) -> dict:
        rows = rows.select(["n", "m"]).drop_null()
        p, t = (rows[c].cast(pa.float64()) for c in ("n", "m"))
        e = pc.subtract(p, t)
        percent = pc.multiply(100.0, pc.if_else(pc.equal(t, 0), e, pc.divide(e, pc.if_else(pc.equal(t, 0), 1.0, t))))
        square = lambda x: pc.multiply(x, x)
        every = {"e": e, "ae": pc.abs(e), "pe": percent, "ape": pc.abs(percent), "ee": square(e), "t": t, "tt": square(t), "p": p, "pp": square(p), "tp": pc.multiply(t, p)}
        return {"k": rows.num_rows, **{k: pc.sum(v).as_py() or 0.0 for k, v in every.items()}}

    def merge(self, states: pa.Table) -> dict:
        return _sums(states)

    def finish(self, s: dict) -> dict:
        k = s["k"]
        spread = lambda xx, x: xx - x * x / k if k else 0.0
        both = sqrt(max(spread(s["tt"], s["t"]) * spread(s["pp"], s["p"]), 0.0))
        mse, lost = _over(s["ee"], k), _over(s["ee"], spread(s["tt"], s["t"]))
        return {
            "me": _over(s["e"], k), "mae": _over(s["ae"], k), "mpe": _over(s["pe"], k), "mape": _over(s["ape"], k), "mse": mse, "rmse": None if mse is None else sqrt(mse),
            "r": _over(s["tp"] - s["t"] * s["p"] / k, both) if k else None, "r2": None if lost is None else 1 - lost,
        }


class PlaceJudge(Aggregator):
    """Nearest distances (``side`` predicted or true, ``distance`` or null) as precision, recall and F at every radius, and both mean distances.

    A point without a counterpart is a miss at every radius and has no part in a mean distance.
    """

    result = "precision array<double>, recall array<double>, f array<double>, mean_predicted double, mean_true double"
    state = "n array<long>, near array<long>, total array<double>, hits_predicted array<long>, hits_true array<long>"

    def __init__(self, radii: int = 15):
        self.radii = radii

    def reduce(self, rows: pa.Table) -> dict:
        out = {"n": [], "near": [], "total": []}
        for side in ("predicted", "true"):
            distance = rows.filter(pc.equal(rows["side"], side))["distance"]
            out["n"].append(len(distance))
            out["near"].append(len(distance) - distance.null_count)
            out["total"].append(pc.sum(distance).as_py() or 0.0)
            out[f"hits_{side}"] = [pc.sum(pc.less_equal(distance, float(r))).as_py() or 0 for r in range(self.radii + 1)]
        return out

    def merge(self, states: pa.Table) -> dict:
        return {c: [sum(x) for x in zip(*states[c].to_pylist())] for c in states.column_names}

    def finish(self, s: dict) -> dict:
        precision = [_over(h, s["n"][0]) for h in s["hits_predicted"]]
        recall = [_over(h, s["n"][1]) for h in s["hits_true"]]
        f = [2 * p * r / (p + r) if p and r else 0.0 for p, r in zip(precision, recall)]
        means = [_over(t, n) for t, n in zip(s["total"], s["near"])]
        return {"precision": precision, "recall": recall, "f": f, "mean_predicted": means[0], "mean_true": means[1]}
