"""Language identification of code-switched text by a linear-chain CRF.

Words are labelled with languages.  A word's emission score sums weights of
its affixes, its character n-grams and, for words of the training lexicon,
its own entry; learned transitions join neighbouring words.  Training
maximises the conditional likelihood of word sequences of labelled documents,
part of which are spliced from two documents so that real switches occur.
Prediction runs forward-backward over every word of every text.

Long texts do not serialise a batch: the words of all texts of a step form
blocks of equal length, transfer matrices of all blocks are built together,
a short scan per text links its blocks, and the marginals inside the blocks
follow, again together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, fresh, steps

#: Maximal runs of letters (numeric characters that Unicode calls alphanumeric may join them).
WORD = re.compile(r"[^\W\d_]+")
#: Distinct texts per language that a model is trained on, at most.
ROWS_PER_LABEL = 250
#: Texts of all languages together, at most; many languages share it evenly.
MOST_ROWS = 20_000
#: Pieces that one text gives to training, at most, and their words.
PIECES, PIECE_WORDS = 16, 24
_BLOCK = 32
_CACHE = 200_000


def features(word: str) -> list[str]:
    """Affixes, n-grams and the lexicon entry of a lower-cased word."""
    framed = f"^{word}$"
    out = ["w" + word]
    out += ["p" + word[:n] for n in (1, 2, 3)]
    out += ["s" + word[-n:] for n in (1, 2, 3)]
    out += [framed[i : i + 2] for i in range(len(framed) - 1)]
    out += [framed[i : i + 3] for i in range(len(framed) - 2)]
    return out


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Per word the summed weights per label, and the share of its features that the model knows."""
        get, found, sizes, known = self.index.get, [], [], []
        for word in words:
            own = features(word)
            met = [i for i in map(get, own) if i is not None]
            found += met
            sizes.append(len(met))
            known.append(len(met) / len(own))
        sizes = np.array(sizes)
        out = np.zeros((len(words), len(self.labels) + 1))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some, :-1] = np.add.reduceat(self.weights[found], (np.cumsum(sizes) - sizes)[some], axis=0)
        out[:, -1] = known
        return out


class _Emissions:
    """Emissions of the words met so far, numbered; those met least are let go beyond ``_CACHE`` words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table, self.met = np.zeros((1 << 12, len(model.labels) + 1)), np.zeros(1 << 12, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of every word."""
        ids = list(map(self.known.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i is None))
            n, upto = len(self.known), len(self.known) + len(new)
            while upto > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.table[n:upto] = self.model.emissions(new)
            self.met[n:upto] = 0
            self.known.update(zip(new, range(n, upto), strict=True))
            ids = list(map(self.known.get, words))
        ids = np.array(ids, np.int64)
        self.met[: len(self.known)] += np.bincount(ids, minlength=len(self.known))
        return ids

    def trim(self) -> None:
        n = len(self.known)
        if n <= _CACHE:
            return
        met = self.met[:n]
        by_use = np.bincount(np.minimum(met, 255), minlength=256)[::-1].cumsum()[::-1]  # words met at least so often
        keep = met >= max(1, int(np.searchsorted(-by_use, -_CACHE / 2)))
        self.known = {w: i for i, w in enumerate(compress(list(self.known), keep.tolist()))}
        self.table[: len(self.known)], self.met[: len(self.known)] = self.table[:n][keep], met[keep] // 2


def _forward_backward(scores: np.ndarray, transitions: np.ndarray):
    """Word marginals and summed pair marginals of equally long sequences (sequence, word, label)."""
    n, length, k = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ move) * psi[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    beta[:, -1] = 1 / k
    for t in range(length - 2, -1, -1):
        b = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move * (psi * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return marginal, pair.sum(axis=(0, 1))


def fit(samples: list[tuple[str, str]], length: int = PIECE_WORDS, epochs: int = 4, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model | None:
    """A model from (text, language) samples; None without labelled words."""
    rng = np.random.default_rng(seed)
    docs = [(WORD.findall(text.lower()), lang) for text, lang in sorted(samples, key=lambda s: (s[1], s[0]))]
    docs = [(words, lang) for words, lang in docs if words]
    labels = sorted({lang for _, lang in docs})
    if not labels:
        return None
    label_of = {lang: i for i, lang in enumerate(labels)}
    types: dict[str, int] = {}
    pieces: list[tuple[np.ndarray, int]] = []
    for words, lang in docs:
        ids = np.array([types.setdefault(w, len(types)) for w in words])
        ids = np.resize(ids, -(-len(ids) // length) * length)  # the last piece starts over with the text's first words
        pieces += [(piece, label_of[lang]) for piece in ids.reshape(-1, length)]
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in features(w)] for w in types]
    sizes = np.array([len(r) for r in rows])
    flat, starts = np.concatenate([np.array(r) for r in rows]), np.cumsum(sizes) - sizes
    words = np.stack([p for p, _ in pieces])
    golds = np.repeat(np.array([g for _, g in pieces])[:, None], length, axis=1)
    other = rng.permutation(len(words))
    spliced = rng.random(len(words)) < 0.5
    place = rng.integers(1, length, len(words))
    late = spliced[:, None] & (np.arange(length) >= place[:, None])
    words, golds = np.where(late, words[other], words), np.where(late, golds[other], golds)

    k = len(labels)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    seen_w, seen_m = np.full(len(index), 1e-8), np.full((k, k), 1e-8)
    batch = 256
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for at in range(0, len(order), batch):
            w, g = words[order[at : at + batch]], golds[order[at : at + batch]]
            kinds, back = np.unique(w, return_inverse=True)
            own = np.repeat(starts[kinds], sizes[kinds])
            nth = np.arange(len(own)) - np.repeat(np.cumsum(sizes[kinds]) - sizes[kinds], sizes[kinds])
            used = flat[own + nth]
            bounds = np.cumsum(sizes[kinds]) - sizes[kinds]
            emitted = np.add.reduceat(weights[used], bounds, axis=0)
            marginal, pair = _forward_backward(emitted[back].reshape(*w.shape, k), moves)
            gap = -marginal
            np.put_along_axis(gap, g[:, :, None], np.take_along_axis(gap, g[:, :, None], 2) + 1, 2)
            per_kind = np.stack([np.bincount(back.ravel(), gap[:, :, j].ravel(), len(kinds)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(used, np.repeat(per_kind[:, j], sizes[kinds]), len(index)) for j in range(k)], axis=1) / len(w)
            grad -= decay * weights
            true_pair = np.zeros((k, k))
            np.add.at(true_pair, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
            grad_m = (true_pair - pair) / len(w) - decay * moves
            seen_w += (grad**2).sum(axis=1)
            seen_m += grad_m**2
            weights += rate * grad / np.sqrt(seen_w)[:, None]
            moves += rate * grad_m / np.sqrt(seen_m)
    return Model(labels, index, weights, moves)


def held_out():
    """Whether a document is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pieces(length: int, most: int):
    """Pieces of ``length`` words of every text: all, or ``most`` that a hash of the text picks."""

    def run(batches):
        for step in steps(batches):
            langs, pieces = [], []
            for text, lang in zip(step.column("text").to_pylist(), step.column("lang").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                starts = np.arange(0, len(words), length)
                if len(starts) > most:
                    starts = np.sort(np.random.default_rng(zlib.crc32(text.encode())).choice(starts, most, replace=False))
                pieces += [" ".join(words[a : a + length]) for a in starts.tolist()]
                langs += [lang] * len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(langs, pa.string())], ["text", "lang"])

    return run


def train(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL, most_rows: int = MOST_ROWS, pieces: int = PIECES) -> Model | None:
    """Fit on a bounded sample of the documents that are not held out.

    ``docs`` needs doc_id, text, lang.  Of each language up to
    ``rows_per_label`` distinct texts are taken, in order of a hash of the
    text; with many languages that number falls so that all of them together
    have about ``most_rows``, and the ``most_rows`` most frequent ones are
    learned.  A text gives at most ``pieces`` pieces of ``PIECE_WORDS`` words,
    picked by a hash of the text.  These pieces are all that reaches the driver.

    Null ids, texts and languages teach nothing; copies count once.  None is
    returned where nothing is left to learn from.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("key"))
    # at most most_rows rows of a language and a number, so they may be broadcast
    counts = cut(known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows))
    labels = counts.count()
    if not labels:
        return None
    quota = max(1, min(rows_per_label, most_rows // labels))
    place = F.pmod("key", F.lit(1 << 32)) / F.lit(float(1 << 32))
    # a few times as many as are wanted pass this share, whatever the language's size
    few = known.select("lang", "key").join(F.broadcast(counts), "lang").where(place < (3 * quota + 100) / F.col("n")).select("lang", "key").distinct()
    chosen = few.withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy(place, "key"))).where(F.col("turn") <= quota).drop("turn")
    texts = known.join(F.broadcast(chosen), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])
    picked = texts.select("text", "lang").mapInArrow(_pieces(PIECE_WORDS, pieces), "text string, lang string")
    return fit([tuple(r) for r in picked.collect()])


def _marginals(ids: np.ndarray, bounds: np.ndarray, emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Word marginals of many texts; text r has words ids[bounds[r]:bounds[r + 1]], at least one."""
    k = emissions.shape[1]
    move = np.exp(transitions - transitions.max())
    psi_kind = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    sizes = np.diff(bounds)
    per_text = -(-sizes // _BLOCK)
    text = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = bounds[text] + nth * _BLOCK
    length = np.minimum(_BLOCK, bounds[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, opens = start[order], length[order], (nth == 0)[order]
    active = np.searchsorted(-length, -np.arange(_BLOCK), side="left")  # blocks longer than t
    n = len(order)
    psi = np.zeros((_BLOCK, n, k))
    for t in range(_BLOCK):
        psi[t, : active[t]] = psi_kind[ids[start[: active[t]] + t]]

    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(_BLOCK):
        m = active[t]
        step = (through[:m].reshape(-1, k) @ move).reshape(m, k, k)
        if t == 0:
            step[opens[:m]] = 1 / k  # a text begins with no transition
        step *= psi[t, :m, None, :]
        through[:m] = step / step.sum(axis=(1, 2), keepdims=True)

    where = np.empty(n, np.int64)
    where[order] = np.arange(n)  # block in text order -> sorted place
    first = np.cumsum(per_text) - per_text
    inward, backward = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    many = np.argsort(-per_text, kind="stable")
    longer = np.searchsorted(-per_text[many], -np.arange(per_text.max()), side="left")
    for b in range(1, per_text.max()):
        rows = first[many[: longer[b]]] + b
        v = np.einsum("nj,njk->nk", inward[where[rows - 1]], through[where[rows - 1]])
        inward[where[rows]] = v / v.sum(axis=1, keepdims=True)
    for b in range(per_text.max() - 2, -1, -1):
        rows = first[many[: longer[b + 1]]] + b
        v = np.einsum("njk,nk->nj", through[where[rows + 1]], backward[where[rows + 1]])
        backward[where[rows]] = v / v.sum(axis=1, keepdims=True)

    alpha, v = np.zeros_like(psi), inward
    for t in range(_BLOCK):
        m = active[t]
        step = v[:m] @ move
        if t == 0:
            step[opens[:m]] = 1 / k
        step = step * psi[t, :m]
        v = step / step.sum(axis=1, keepdims=True)
        alpha[t, :m] = v
    out = np.empty((len(ids), k))
    v = backward
    for t in range(_BLOCK - 1, -1, -1):
        m = active[t]
        post = alpha[t, :m] * v[:m]
        out[start[:m] + t] = post / post.sum(axis=1, keepdims=True)
        step = (psi[t, :m] * v[:m]) @ move.T
        v = v.copy()
        v[:m] = step / step.sum(axis=1, keepdims=True)
    return out


_RESULT = {"lang_pred": "string", "score": "double", "n_words": "long", "segments": "string"}
_VERDICT = _RESULT | {"known": "double"}


def _label(shared: Broadcast):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**shared.value) if shared.value else None
        k = len(model.labels) if model else 0
        names = np.array(model.labels if model else [], dtype=object)
        held = _Emissions(model) if model else None
        for step in steps((pa.RecordBatch.from_arrays([c], ["text"]) for c in columns), limit=1 << 19):
            every, sizes = [], []
            for text in step.column("text").to_pylist():
                words = WORD.findall(text.lower()) if k else []
                if words and not any(map(str.isalpha, words)) and not any(map(str.isalpha, text)):
                    words = []
                every += words
                sizes.append(len(words))
            sizes = np.array(sizes)
            pred, runs = np.full(len(sizes), "und", object), np.full(len(sizes), "", object)
            score, known = np.zeros(len(sizes)), np.zeros(len(sizes))
            full = np.flatnonzero(sizes)
            if len(full):
                held.trim()
                bounds = np.append(0, np.cumsum(sizes[full]))
                ids = held.numbers(every)
                known[full] = np.add.reduceat(held.table[ids, k], bounds[:-1]) / sizes[full]
                post = _marginals(ids, bounds, held.table[: len(held.known), :k], model.transitions)
                mean = np.add.reduceat(post, bounds[:-1], axis=0) / sizes[full][:, None]
                best = mean.argmax(axis=1)
                pred[full], score[full] = names[best], np.clip(mean[np.arange(len(full)), best], 0, 1)
                label = post.argmax(axis=1)
                turn = np.append(True, label[1:] != label[:-1])
                turn[bounds[:-1]] = True
                turns = np.flatnonzero(turn)
                lengths = np.diff(np.append(turns, len(label)))
                said = [f"{names[a]}*{n}" for a, n in zip(label[turns], lengths, strict=True)]
                cuts = np.searchsorted(turns, bounds)
                runs[full] = [" ".join(said[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            found = [pa.array(pred, pa.string()), pa.array(score), pa.array(sizes.astype(np.int64)), pa.array(runs, pa.string()), pa.array(known)]
            yield pa.StructArray.from_arrays(found, names=list(_VERDICT))

    return run


def verdict(text: Column, model: Model | None) -> Column:
    """What :func:`identify` finds in a text, as one struct column.

    Its fields are lang_pred, score, n_words, segments and known: the mean over
    words of the share of a word's features that the model has met, which says
    how far the text is made of any language that was learned, however many
    there are and however they are mixed.  Only the text goes through Python.
    """
    shared = SparkSession.active().sparkContext.broadcast(vars(model) if model else None)
    judge = F.arrow_udf(_label(shared), ", ".join(f"{c} {kind}" for c, kind in _VERDICT.items()))
    return judge.asNondeterministic()(text)  # kept from being run once per field


def identify(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """Languages of every text, by word and as a whole.

    ``docs`` needs doc_id and text; other columns are no input of a prediction.
    Result per row: doc_id, lang_pred (the language with the highest mean word
    marginal), score (that mean), n_words, segments (labels of neighbouring
    words as ``label*count``, in order).  ``keep`` carries all columns of
    ``docs`` along, but for those named like a result.

    Null texts, texts without a letter, and all texts where there was nothing
    to learn from, give ``und``, score 0 and no segments.  Ties go to the label
    first in code point order.  Repeated rows and null ids are treated like
    others; an empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in _RESULT] if keep else [F.col("doc_id").cast("long").alias("doc_id")]
    (name,) = fresh(docs, "verdict")
    judged = docs.select(*kept, verdict(F.col("text"), model).alias(name))
    return judged.select(*[c for c in judged.columns if c != name], *[F.col(name)[c].alias(c) for c in _RESULT])
