"""Alignment of two tokenizers over the same text.

A text is encoded by a byte-level vocabulary and by a piece vocabulary.  Both
token lists are flattened with their documents as parent indices, token lengths
are summed within documents, and an Acero join on (document, end) finds where
tokens of either kind end.  Ends on both sides cut the text into groups; every
end closes exactly one pair of tokens that overlap, which is a link.  Links are
counted per document and pair in Arrow, and partial counts of documents per
pair are merged by Spark.

All work on tokens is Arrow compute on whole columns; Python handles one step
of texts at a time.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, fresh, steps

FOLDER = "/opt/tokenizers"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: the pattern that parts text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes that are aligned together.
STEP = 1 << 20
#: Pairs that a task counts before it hands partial counts on.
PARTIAL = 1 << 18
#: Pairs whose counts are broadcast, those of most documents first; all others are joined.
FREQUENT = 1 << 20
_PAIR = 32  # bits of the second id in a pair
_ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "n_best", "count_sum")


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level token stands for: itself where printable, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokens(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary without its special tokens; ids are in order of merges."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {t["content"] for t in known["added_tokens"]}
    of = _byte_of()
    return {bytes(of[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in special}


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of every piece of a piece vocabulary; control pieces have none."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = pieces.get_piece_size()
    return [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]


def _joined(ids: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """Each list's tokens as one binary."""
    spelled = vocabulary.take(ids.flatten())
    ends = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
    bounds = ends[np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), spelled.buffers()[2]])


def _ends(ids: pa.Array, vocabulary: pa.Array, name: str) -> tuple[pa.Array, pa.Table]:
    """Flat token ids, and a table of (doc, end, place): each token's end in its document."""
    flat, parents = ids.flatten(), pc.list_parent_indices(ids).cast(pa.int64())
    running = pc.cumulative_sum(pc.binary_length(vocabulary.take(flat)))
    before = np.append(0, running.to_numpy())[np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))[:-1]]
    ends = pc.subtract(running, pa.array(before).take(parents))  # sums start anew in every document
    return flat, pa.table({"doc": parents, "end": ends, name: pa.array(np.arange(len(flat)))})


def _grouped(flat: pa.Array, last: np.ndarray, names: pa.Array) -> pa.Array:
    """Decimal ids of the groups that end at the given places, comma-joined."""
    offsets = pa.array(np.append(0, last + 1).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(flat)), ",")


def _aligned(a: pa.Array, b: pa.Array, vocabulary_a: pa.Array, vocabulary_b: pa.Array, names: pa.Array):
    """Per document: groups, links, the groups' text, distinct pairs and how often each is linked."""
    n = len(a)
    flat_a, table_a = _ends(a, vocabulary_a, "a")
    flat_b, table_b = _ends(b, vocabulary_b, "b")
    every = table_a.join(table_b, ["doc", "end"], join_type="full outer", use_threads=False)
    every = every.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    doc, at_a, at_b = (every[c].combine_chunks() for c in ("doc", "a", "b"))
    both = pc.and_(at_a.is_valid(), at_b.is_valid())
    last_a, last_b = at_a.filter(both).to_numpy(), at_b.filter(both).to_numpy()
    n_links = np.bincount(doc.to_numpy(), minlength=n)
    n_groups = np.bincount(doc.filter(both).to_numpy(), minlength=n)

    spelled = pc.binary_join_element_wise(_grouped(flat_a, last_a, names), _grouped(flat_b, last_b, names), "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)).astype(np.int32)), spelled), ";")

    # the token over an end is the one that ends there or next
    id_a, id_b = (flat.take(pc.fill_null_backward(at)).cast(pa.int64()) for flat, at in ((flat_a, at_a), (flat_b, at_b)))
    pair = pc.add(pc.shift_left(id_a, pa.scalar(_PAIR, pa.int64())), id_b)
    counted = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(counted["doc"].to_numpy(), minlength=n))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, counted[c].combine_chunks()) for c in ("pair", "count_all")]
    return n_groups, n_links, groups, *lists


def align(docs: DataFrame, folder: str = FOLDER, byte_file: str = BYTES, piece_file: str = PIECES) -> DataFrame:
    """Tokens, groups and links of every text.

    ``docs`` needs ``text``, which goes; its other columns are kept, but for
    those of the names added: n_a and n_b (tokens of the byte-level and of the
    piece vocabulary), n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), pairs
    (distinct linked ids, a shifted by 32 bits plus b, ascending) and times (how
    often each is linked).

    The byte-level vocabulary encodes a space and the text, the piece vocabulary
    the text, as it adds the space.  Special tokens in a text are plain text.
    Null and empty texts, and texts whose tokens do not spell a space and the
    text on both sides, have no tokens: zeros, an empty string, empty lists.
    A task holds the tokens of about ``STEP`` bytes of text, or of one longer text.

    Vocabularies are read on the driver and broadcast; their size is fixed.
    """
    with open(os.path.join(folder, piece_file), "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((byte_tokens(os.path.join(folder, byte_file)), model))
    kept = [c for c in docs.columns if c not in (*_ADDED, "text")]
    (text,) = fresh(docs, "whole")
    rows = docs.select(*kept, F.col("text").alias(text))
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1]), "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"])

    def run(batches):
        ranks, proto = shared.value
        left = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        right = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelled[i] = token
        vocabulary_a, vocabulary_b = pa.array(spelled, pa.large_binary()), pa.array(piece_bytes(proto), pa.large_binary())
        names = pa.array([str(i) for i in range(max(len(vocabulary_a), len(vocabulary_b)))], pa.string())
        for step in steps(batches, text, limit=STEP):
            column = step.column(step.schema.get_field_index(text))
            texts = column.to_pylist()
            a = pa.array([left.encode_ordinary(" " + t) if t else [] for t in texts], pa.list_(pa.int32()))
            b = pa.array(right.encode(texts, num_threads=1), pa.list_(pa.int32()))
            whole = pc.binary_join_element_wise("", column, " ").cast(pa.large_binary())
            good = pc.and_(pc.equal(_joined(a, vocabulary_a), whole), pc.equal(_joined(b, vocabulary_b), whole))
            place = np.flatnonzero(good.to_numpy(zero_copy_only=False))
            a, b = a.filter(good), b.filter(good)
            n_groups, n_links, groups, pairs, times = _aligned(a, b, vocabulary_a, vocabulary_b, names)
            slot = np.full(len(texts), -1)
            slot[place] = np.arange(len(place))
            at = pa.array(slot, mask=slot < 0)
            counts = [pa.array(x, pa.int64()) for x in (pc.list_value_length(a), pc.list_value_length(b), n_groups, n_links)]
            columns = [pc.fill_null(c.take(at), 0) for c in counts] + [pc.fill_null(groups.take(at), "")]
            columns += [pc.if_else(good, c.take(at), pa.scalar([], c.type)) for c in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(step.column(i) for i in range(len(kept))), *columns], [*kept, *(x for x in _ADDED[:7])])

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Documents that hold each linked pair: (pair, docs, best), best where it is the most of the pair's first id."""

    def partial(batches):
        held, n = [], 0

        def counted():
            table = pa.Table.from_batches(held).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
            return pa.table({"pair": table["pair"], "docs": table["docs_sum"]}).combine_chunks().to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                flat = batch.slice(at, 256).column(0).flatten()
                held.append(pa.RecordBatch.from_arrays([flat, pa.array(np.ones(len(flat), np.int64))], ["pair", "docs"]))
                n += len(flat)
                if n >= PARTIAL:
                    held = counted()
                    if sum(b.num_rows for b in held) > PARTIAL // 2:  # few repeats: hand them on
                        yield from held
                        held = []
                    n = sum(b.num_rows for b in held)
        if held:
            yield from counted()

    docs = aligned.select("pairs").mapInArrow(partial, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(W.partitionBy(F.shiftright("pair", _PAIR)))  # a first id has as many pairs as there are second ids at most
    return docs.withColumn("best", F.col("docs") == most)


def score_links(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times.

    A link's count is the number of documents that hold its pair, over all
    rows.  count_sum adds the counts of a document's links, n_best counts
    links whose count is the highest of their first id.

    Counts of pairs in most documents, ``frequent`` at most, are looked up where the
    documents are; links of all other pairs, each in few documents, are joined.
    Repeated rows count as documents each on its own; an empty table gives an empty result.
    """
    row, found_best, found_sum, rest = fresh(aligned, "row", "best_", "sum_", "rest")
    held = cut(aligned.withColumn(row, F.monotonically_increasing_id()))
    counts = cut(pair_counts(held))
    size = F.floor(F.log2(F.col("docs")))
    sizes = {r["size"]: r["n"] for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    least, room = 64, frequent
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    near = counts.where(size >= least).orderBy("pair").toArrow()
    shared = held.sparkSession.sparkContext.broadcast(tuple(near[c].to_numpy() for c in ("pair", "docs", "best")))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in held.dtypes if c not in ("pairs", "times")), f"`{found_best}` long, `{found_sum}` long, `{rest}` array<struct<pair:long,times:long>>"])

    def run(batches):
        pair, docs, best = shared.value
        known = pa.array(pair, pa.int64())
        docs, best = pa.array(docs, pa.int64()), pa.array(best.astype(np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                step = batch.slice(at, 256)
                lists = step.column(step.schema.get_field_index("pairs"))
                times = step.column(step.schema.get_field_index("times")).flatten()
                parents, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
                place = pc.index_in(flat, value_set=known)
                sums = []
                for of in (best, docs):
                    product = pc.multiply(times, pc.fill_null(of.take(place), 0))
                    upto = np.append(0, pc.cumulative_sum(product).to_numpy())
                    sums.append(pa.array(np.diff(upto[np.searchsorted(parents, np.arange(step.num_rows + 1))])))
                far = place.is_null()
                each = pa.StructArray.from_arrays([flat.filter(far), times.filter(far)], ["pair", "times"])
                per = np.bincount(parents[far.to_numpy(zero_copy_only=False)], minlength=step.num_rows)
                left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), each)
                others = [(i, c) for i, c in enumerate(step.schema.names) if c not in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([*(step.column(i) for i, _ in others), *sums, left], [*(c for _, c in others), found_best, found_sum, rest])

    near_sums = held.mapInArrow(run, schema)
    if not any(sizes.get(i, 0) for i in range(least)):  # no pair is left to join
        return near_sums.select(*kept, F.col(found_best).alias("n_best"), F.col(found_sum).alias("count_sum"))
    near_sums = cut(near_sums)
    links = near_sums.select(row, F.explode(rest).alias("x")).select(row, "x.pair", "x.times").join(counts.where(size < least), "pair")
    far_sums = links.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best"), F.sum(F.col("times") * F.col("docs")).alias("far_sum"))
    both = near_sums.join(far_sums.withColumnRenamed(row, f"{row}_far"), F.col(row) == F.col(f"{row}_far"), "left")
    total = lambda near, far: F.col(near) + F.coalesce(F.col(far), F.lit(0))
    return both.select(*kept, total(found_best, "far_best").alias("n_best"), total(found_sum, "far_sum").alias("count_sum"))
