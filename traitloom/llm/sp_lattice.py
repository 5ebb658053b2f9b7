"""Sampled SentencePiece segmentation: forward filtering, backward sampling.

A text's piece lattice is filtered forward (the summed weight of all ways to
reach a character) and sampled backward from its end, each piece in proportion
to the weight of the ways that it completes.  The random numbers are hashes of
the row key and the place, so a key always gives the same segmentation.

The vocabulary is a public one and never trained.  It is a merge table without
probabilities, so a piece weighs as Zipf's law says for its rank, raised to
``sharpness``.  No piece reaches across a word's end (this is checked when it
is read), which lets the lattice of a chunk be filtered once per distinct chunk; sampling then walks
all chunks of a step backward at the same time.

Characters without a piece become their UTF-8 bytes' pieces, and so does the
character that stands for a space in the vocabulary, so decoding restores
every text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix, raw_text, steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CHUNK = regex.compile(r"\n| *\p{L}+| *[^\p{L} \n]+| +")
#: Lattice nodes kept for chunks met before; beyond it, those met least are let go.
_NODES = 800_000
#: Chunks up to this length are filtered together, longer ones one by one.
_TOGETHER = 64
#: Weights are scaled by this per character, which keeps products in range.
_SCALE = 1e3
_BASE = np.uint64(0xD1342543DE82EF95)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float] | None]  # text of a piece (a real space for SPACE): id and weight; None for beginnings of pieces
    longest: int
    byte_ids: list[int]
    texts: list[bytes]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per length: sorted hashes, ids (-1 for beginnings), scaled weights


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
    return h


def vocabulary(path: str = MODEL, sharpness: float = 1.0) -> Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, weighted by rank."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    ids, texts, byte_ids = {}, [b""] * size, [0] * 256
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = piece.replace(SPACE, " ")
            texts[i] = text.encode()
            rank = min(-model.get_score(i), size)
            if len(_CHUNK.findall(text)) != 1:
                raise ValueError(f"piece {piece!r} reaches across a chunk")
            ids[text] = (i, (rank + 10) ** -sharpness * _SCALE ** len(text))
    pieces = {text[:n]: None for text in ids for n in range(1, len(text))} | ids
    longest = max(map(len, ids))
    tables = []
    for n in range(1, longest + 1):
        rows = sorted((_hash(text), known[0] if known else -1, known[1] if known else 0.0) for text, known in pieces.items() if len(text) == n)
        tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])))
    return Vocabulary(pieces, longest, byte_ids, texts, tables)


def lattice(chunk: str, vocab: Vocabulary) -> list[list[tuple[int, int, float]]]:
    """Edges into every character end of one chunk: (length, code, weight) lists, shortest first.

    A code is a piece id or, for a character given as bytes, the vocabulary's
    size plus its code point; such a character has no other edge, so its weight
    does not matter.  A weight is the summed weight of all ways to reach the
    end over this edge, relative to the others into the same end; backward
    sampling takes the edge in proportion to it.

    The filter runs left to right; where weights leave the middle range, the
    positions that are still open are rescaled together.
    """
    n, pieces, size, longest = len(chunk), vocab.pieces, len(vocab.texts), vocab.longest
    filtered, ends = [0.0] * (n + 1), [[] for _ in range(n)]
    filtered[0] = 1.0
    for start in range(n):
        here = filtered[start]
        if not 1e-100 < here < 1e100:
            factor = 1 / here
            for at in range(start, min(n, start + longest) + 1):
                filtered[at] *= factor
                if at > start:
                    ends[at - 1] = [(length, code, weight * factor) for length, code, weight in ends[at - 1]]
            here = 1.0
        alone = True
        for end in range(start + 1, min(n, start + longest) + 1):
            known = pieces.get(chunk[start:end], False)
            if known is False:  # begins no piece
                break
            if known:
                weight = here * known[1]
                filtered[end] += weight
                ends[end - 1].append((end - start, known[0], weight))
                alone = alone and end > start + 1
        if alone:
            filtered[start + 1] += here
            ends[start].append((1, size + ord(chunk[start]), here))
    return [edges[::-1] for edges in ends]


def lattices(chunks: list[str], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """The lattices of many chunks at once: end (a running character), length, code, weight of every edge.

    Edges are in order of end and then length, as :func:`lattice` has them.
    All characters look up one length after another, as long as what they
    begin also begins a piece; the filter runs over places in the chunks.
    """
    letters = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(c) for c in chunks])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(letters)) - first
    left = np.repeat(sizes, sizes) - place
    alive, h = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
    found = []
    for n, (hashes, ids, weights) in enumerate(vocab.tables, 1):
        keep = left[alive] >= n
        alive, h = alive[keep], h[keep]
        h = h * _BASE + letters[alive + (n - 1)]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        keep = hashes[at] == h
        alive, h, at = alive[keep], h[keep], at[keep]
        hit = ids[at] >= 0
        found.append((alive[hit], np.full(int(hit.sum()), n), ids[at[hit]].astype(np.int64), weights[at[hit]]))
        if n == 1:
            single = np.zeros(len(letters), bool)
            single[found[0][0]] = True
            rest = np.flatnonzero(~single)
            found.append((rest, np.ones(len(rest), np.int64), len(vocab.texts) + letters[rest].astype(np.int64), np.ones(len(rest))))
    start, length, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place[start], kind="stable")
    start, length, code, weight = start[order], length[order], code[order], weight[order]
    bounds = np.searchsorted(place[start], np.arange(int(sizes.max()) + 1))
    filtered = (place == 0).astype(np.float64)
    filtered = np.append(filtered, 0.0)
    inner = place[start] + length < (left + place)[start]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        weight[a:b] *= filtered[start[a:b]]
        on = inner[a:b]
        np.add.at(filtered, (start[a:b] + length[a:b])[on], weight[a:b][on])
    end = start + length - 1
    order = np.lexsort((length, end))
    return end[order], length[order], code[order], weight[order]


class _Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.data[: self.n]

    def set(self, values: np.ndarray) -> None:
        self.data[: len(values)], self.n = values, len(values)


class _Lattices:
    """The lattices of the chunks met so far, as flat arrays that sampling can search.

    A node is a character end, its edges follow one another.  An edge has the
    share of the node's weight up to this edge, in steps of 2**-24, which
    single precision holds exactly; a draw never depends on the order in which
    chunks were met.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.nodes = vocab, {}, 0
        self.first, self.length, self.met = _Column(np.int64), _Column(np.int64), _Column(np.int64)
        self.begin = _Column(np.int32)  # first edge of every node
        self.shares, self.codes, self.spans = _Column(np.float32), _Column(np.int32), _Column(np.int16)

    def add(self, chunks: list[str]) -> None:
        """Filter chunks that are not known yet."""
        short = [c for c in chunks if len(c) <= _TOGETHER]
        if short:
            self._take(short, *lattices(short, self.vocab))
        for chunk in chunks:
            if len(chunk) > _TOGETHER:
                edges = [(i, *e) for i, into in enumerate(lattice(chunk, self.vocab)) for e in into]
                self._take([chunk], *(np.array(c) for c in zip(*edges, strict=True)))

    def trim(self, most: int) -> None:
        """Let chunks go that were met least, until at most half of ``most`` nodes are left, if there are more than ``most``."""
        if self.nodes <= most:
            return
        length, met = self.length.view(), self.met.view()
        by_use = np.bincount(np.minimum(met, 255), length, 256)[::-1].cumsum()[::-1]  # nodes of chunks met at least so often
        least = int(np.searchsorted(-by_use, -most / 2))
        keep = met >= max(least, 1)
        first, length = self.first.view()[keep], length[keep]
        new = np.cumsum(length) - length
        nodes = np.repeat(first - new, length) + np.arange(int(length.sum()))
        begin = self.begin.view()
        edges_of = np.diff(np.append(begin, self.codes.n))[nodes]
        starts = np.cumsum(edges_of) - edges_of
        edges = np.repeat(begin[nodes] - starts, edges_of) + np.arange(int(edges_of.sum()))
        for column in (self.codes, self.spans, self.shares):
            column.set(column.view()[edges])
        self.begin.set(starts)
        self.known = {chunk: i for i, chunk in enumerate(compress(list(self.known), keep.tolist()))}
        self.first.set(new)
        self.length.set(length)
        self.met.set(met[keep] // 2)
        self.nodes = int(length.sum())

    def _take(self, chunks, end, length, code, weight) -> None:
        sizes = np.array([len(c) for c in chunks])
        for chunk in chunks:
            self.known[chunk] = len(self.known)
        self.first.extend(self.nodes + np.cumsum(sizes) - sizes)
        self.length.extend(sizes)
        self.met.extend(np.zeros(len(sizes), np.int64))
        opens = np.append(True, end[1:] != end[:-1])
        last = np.append(opens[1:], True)
        begin = np.flatnonzero(opens)
        turn = np.arange(len(end)) - np.repeat(begin, np.diff(np.append(begin, len(end))))
        upto = weight.astype(np.float64).copy()
        for t in range(1, int(turn.max()) + 1):
            at = np.flatnonzero(turn == t)
            upto[at] += upto[at - 1]
        total = np.repeat(upto[last], np.diff(np.append(begin, len(end))))
        self.begin.extend(self.codes.n + begin)
        self.shares.extend(np.where(last, 1.0, np.round(upto / total * 2**24) / 2**24))
        self.codes.extend(code)
        self.spans.extend(length)
        self.nodes += int(sizes.sum())

    def sample(self, kinds: np.ndarray, seeds: np.ndarray):
        """Codes of all chunks, in order, and how many each has."""
        self.met.view()[:] += np.bincount(kinds, minlength=self.met.n)
        first, place = self.first.view()[kinds], self.length.view()[kinds]
        begin, shares, all_codes, spans = self.begin.view(), self.shares.view(), self.codes.view(), self.spans.view()
        alive, turn, walked = np.arange(len(kinds)), 0, []
        count = np.zeros(len(kinds), np.int64)
        while len(alive):
            u = (mix(seeds[alive] + np.uint64(turn * int(_STRIDE) % 2**64)) >> np.uint64(40)).astype(np.float32) / np.float32(2**24)
            edge = begin[first[alive] + place[alive] - 1]
            beyond = np.flatnonzero(shares[edge] <= u)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[shares[edge[beyond]] <= u[beyond]]
            walked.append((alive, all_codes[edge]))
            count[alive] += 1
            place[alive] -= spans[edge]
            alive = alive[place[alive] > 0]
            turn += 1
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for turn, (who, codes) in enumerate(walked):
            out[ends[who] - 1 - turn] = codes
        return out, count


def _as_ids(codes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes with characters given as bytes expanded, and each code's number of ids."""
    size = len(vocab.texts)
    rest = np.flatnonzero(codes >= size)
    count = np.ones(len(codes), np.int64)
    if not len(rest):
        return codes, count
    spelled = [[vocab.byte_ids[b] for b in chr(c - size).encode()] for c in codes[rest].tolist()]
    count[rest] = [len(s) for s in spelled]
    out = np.repeat(codes, count)
    out[np.repeat(codes >= size, count)] = np.concatenate([np.array(s) for s in spelled])
    return out, count


def _encode(shared, seed: int, back: bool = False):
    """Sampled pieces of every text; ``back`` adds the text that they decode to."""

    def run(batches):
        vocab = Vocabulary(**shared.value)
        texts = pa.array(vocab.texts, pa.large_binary())
        held = _Lattices(vocab)
        for step in steps(batches, limit=1 << 18):
            held.trim(_NODES)
            chunks, sizes = [], []
            for text in step.column("text").to_pylist():
                own = _CHUNK.findall(" " + text) if text else []
                chunks += own
                sizes.append(len(own))
            kinds = list(map(held.known.get, chunks))
            if None in kinds:
                held.add(list(dict.fromkeys(c for c, kind in zip(chunks, kinds, strict=True) if kind is None)))
                kinds = list(map(held.known.get, chunks))
            sizes = np.array(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = step.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            seeds = mix(mix(keys * _STRIDE + np.uint64(seed))[row] + nth.astype(np.uint64))
            codes, per_chunk = held.sample(np.array(kinds, np.int64), seeds)
            ids, per_code = _as_ids(codes, vocab)
            upto = np.append(0, np.cumsum(per_code))[np.append(0, np.cumsum(per_chunk))]
            bounds = upto[np.append(0, np.cumsum(sizes))].astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            out = pa.RecordBatch.from_arrays([step.column("doc_id"), pieces], ["doc_id", "pieces"])
            yield out.append_column("text", _spelled(pieces, texts)) if back else out

    return run


def encode(docs: DataFrame, path: str = MODEL, sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """Sampled piece ids of every text.

    ``docs`` needs doc_id (the row key) and text; other columns are ignored.
    Result per row: doc_id, pieces (array of ids).  A space is put in front of
    every text that is not empty.  Null and empty texts have no pieces.  Equal
    rows get equal pieces; null ids share the key 0.  An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary(path, sharpness)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(_encode(shared, seed), "doc_id long, pieces array<int>")


def round_trip(docs: DataFrame, path: str = MODEL, sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: doc_id, pieces, and the text that the pieces decode to.

    Nulls, repeated rows and empty tables are treated as these two say.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary(path, sharpness)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(_encode(shared, seed, back=True), "doc_id long, pieces array<int>, text string")


def _spelled(lists: pa.Array, texts: pa.Array) -> pa.Array:
    """The texts of lists of pieces, without the space that was put in front."""
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    data, ends = raw_text(texts.take(lists.flatten()))
    whole = data.tobytes()
    cuts = ends[np.append(0, np.cumsum(sizes))].tolist()
    return pa.array([whole[a + 1 : b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def _decode(shared):
    def run(batches):
        texts = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.append_column("text", _spelled(part.column("pieces"), texts))

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, pieces) with the decoded text.

    Null and empty pieces decode to an empty text, repeated rows and null ids
    like others; other columns are ignored.  An empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path).texts)
    return encoded.select("doc_id", "pieces").mapInArrow(_decode(shared), "doc_id long, pieces array<int>, text string")
