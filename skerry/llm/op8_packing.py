"""Best-fit packing in bulk-synchronous rounds.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. A round then

* opens as many new sequences, each for one of the longest pieces left, as the tokens left exceed the room left
  (pieces of over half the capacity always open their own), by a histogram over piece lengths that has at most
  ``capacity`` rows;
* aims each gap at a length that is still waiting (by the histogram) and within its limit: the longest that fits. With several ranges, a gap that any length fits, or that has found the
  range below its size empty, draws one in proportion to the tokens of the longest lengths that fill half of all room, so that gaps spread over ranges instead of chasing the same pieces;
* range-sorts pieces by length and gaps by aim, so that each partition holds a range of sizes (one range, where no more than ROWS_PER_RANGE are left);
* sweeps each partition upwards: a gap takes the longest piece within its aim; pieces of equal length are taken in rank
  order, so two gaps never take the same piece, and what is left of a gap is tried again at once. A gap that finds no more in its range is carried
  over the border: its limit falls below that range;
* writes placed pieces, and gaps with their new sizes and limits, to the shared folder.

In every round each open gap takes a piece or its limit falls, and without an open gap a sequence is opened; so rounds end only when no piece is left. A gap whose
limit is below every piece is closed. An offset is how far the sequence was filled, so sequences have no holes. Sizes that very many pieces share are spread by their row number.

Null and empty texts are one piece holding the end token alone. Repeated rows are packed each by itself; null ids are
carried along. Very long texts form a block of their own and are cut like others. An empty table gives no rows. Columns besides id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import mix, text_blocks
from skerry.llm.shared import Scratch
from skerry.llm.wordcodes import WordEncoder

CAPACITY, END_ID = 4096, 1
#: A range partition holds about so many pieces and gaps.
ROWS_PER_RANGE = 100_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = f"kind int, size long, reach long, uid long, {PIECE}, sequence_id long, offset long"
WAITING, GAP, PLACED = 0, 1, 2


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                ids, at = encoder.encode(b, end_id)
                count = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(b.docs), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.docs).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def sweep(kind: np.ndarray, size: np.ndarray, reach: np.ndarray, sequence: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """One upward sweep over rows in ascending reach (a piece's length, a gap's aim), pieces before gaps of equal reach: their new kind, size, reach (a gap's limit), sequence and offset."""
    kind, size, reach, sequence, offset = kind.copy(), size.copy(), reach.copy(), sequence.copy(), np.zeros(len(size), np.int64)
    lengths: list[int] = []
    rows: list[int] = []
    kinds, sizes, below = kind.tolist(), size.tolist(), int(reach[0]) - 1
    for r in range(len(kinds)):
        if kinds[r] == WAITING:
            lengths.append(sizes[r]), rows.append(r)
            continue
        gap = sizes[r]
        while lengths:
            k = bisect_right(lengths, gap) - 1
            if k < 0:
                break
            p = rows.pop(k)
            kind[p], sequence[p], offset[p] = PLACED, sequence[r], capacity - gap
            gap -= lengths.pop(k)
        size[r] = gap
        reach[r] = min(gap, below)
    return kind, size, reach, sequence, offset


def _aim(lengths: np.ndarray, tokens: np.ndarray, room: int, turn: int):
    """Gaps with the length that they are to look for; those within whose limit no length is waiting are closed. ``room``: of all gaps, or 0 for a single range."""
    total = np.cumsum(tokens)
    short = max(0.0, total[-1] - room / 2)  # the tokens of lengths that are not yet looked for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            size, limit, uid = (batch.column(names.index(c)).to_numpy() for c in ("size", "reach", "uid"))
            k = np.searchsorted(lengths, limit, "right")
            at = np.maximum(k, 1) - 1
            if room:
                dice = (mix(uid.astype(np.uint64) + np.uint64(turn)) >> np.uint64(11)) / float(1 << 53)
                least = np.where(total[at] > short, short, 0)
                drawn = np.minimum(np.searchsorted(total, least + dice * (total[at] - least), "right"), at)
                at = np.where((limit >= size) & (size < lengths[-1]), at, drawn)
            columns = [pa.array(lengths[at]) if c == "reach" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(k > 0))

    return run


def _round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gather(batches)
        if rows is None:
            return
        new = sweep(*(rows[c].to_numpy() for c in ("kind", "size", "reach", "sequence_id")), capacity)
        for name, value, dtype in zip(("kind", "size", "reach", "sequence_id", "offset"), new, (pa.int32(), *[pa.int64()] * 4), strict=True):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(value, dtype))
        yield from rows.filter(pa.array((new[0] != GAP) | (new[2] > 0))).combine_chunks().to_batches()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECE)
    state = pieces.withColumn("uid", F.monotonically_increasing_id()).selectExpr("0 AS kind", "length AS size", "length AS reach", "uid", *[x.split()[0] for x in PIECE.split(", ")], "0L AS sequence_id", "0L AS offset")
    state = scratch.keep(state, "pieces")
    placed, turn = [], 0
    while True:
        turn += 1
        counts = state.filter(f"kind <> {PLACED}").groupBy("kind", "reach").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # at most twice the capacity
        left = {r["reach"]: r["n"] for r in counts if r["kind"] == WAITING}
        placed.append(state.filter(f"kind = {PLACED}"))
        if not left:
            break
        room = [r for r in counts if r["kind"] == GAP and r["reach"] >= min(left)]
        waiting, gaps = state.filter(f"kind = {WAITING}"), state.filter(f"kind = {GAP} and reach >= {min(left)}")
        short = sum(n * c for n, c in left.items()) - sum(r["size"] for r in room)
        wanted = max(-(-short // capacity), 0 if room else 1)
        least, share = capacity // 2 + 1, 1.0
        wanted -= sum(c for n, c in left.items() if n >= least)
        for n in sorted((n for n in left if n < least), reverse=True):
            if wanted <= 0:
                break
            least, share = n, min(1.0, wanted / left[n])
            wanted -= left[n]
        # Without a gap at least one of the longest pieces opens a sequence, whatever the dice say.
        first = F.lit(-1) if room or share == 1 else F.lit(waiting.filter(f"size = {least}").agg(F.min("uid")).first()[0])
        dice = F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) / float(1 << 20)
        seed = (F.col("size") > least) | ((F.col("size") == least) & ((dice < share) | (F.col("uid") == first)))
        opened = waiting.filter(seed).withColumn("sequence_id", F.col("uid")).withColumn("kind", F.lit(PLACED))
        fresh = opened.filter(f"size < {capacity}").withColumn("size", capacity - F.col("size")).withColumns({"kind": F.lit(GAP), "reach": F.col("size")})
        fresh = fresh.withColumns({c: F.lit(None).cast(fresh.schema[c].dataType) for c in ("doc_id", "piece", "start", "length", "ids_crc32")})
        placed.append(opened)
        stay = {n: c if n < least else c * (1 - share) for n, c in left.items() if n < least or n == least and share < 1}
        lengths = np.array(sorted(stay), np.int64)
        tokens = lengths * np.array([stay[n] for n in lengths.tolist()], float)
        aimed, count = gaps.unionByName(fresh), sum(left.values()) + sum(r["n"] for r in room)
        parts = -(-count // ROWS_PER_RANGE)
        spread = sum(r["size"] for r in room) + sum((capacity - n) * (c - stay.get(n, 0)) for n, c in left.items())
        aimed = aimed.mapInArrow(_aim(lengths, tokens, int(spread) if parts > 1 else 0, turn), STATE) if len(lengths) else aimed.limit(0)
        both = waiting.filter(~seed).unionByName(aimed)
        both = both.repartitionByRange(parts, "reach", F.xxhash64("uid")) if parts > 1 else both.coalesce(1)
        both = both.sortWithinPartitions("reach", "kind", F.xxhash64("uid"))
        state = scratch.keep(both.mapInArrow(_round(capacity), STATE), "round")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
