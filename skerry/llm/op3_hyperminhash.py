"""Near-duplicate detection by HyperMinHash.

1. Each text's distinct shingles (five words, A-Z lower-cased) give, in numpy, the set's size, a 128-bit
   fingerprint of the set, and a sketch of REGISTERS 16-bit registers. Register j holds the smallest hash
   of the set under hash j, compressed to its count of leading zeros (6 bits) and the MANTISSA bits that
   follow the leading one. Every register sees the whole set, as splitting one hash over buckets would leave
   a short text's buckets empty.
2. Texts with equal sets fall into one class, by a pre-aggregated minimum: thousands of copies become one row.
   A class is known by the id and the text hash of one of its rows, so an id with several texts has a class for each.
3. Classes are banded on compressed registers. In each bucket every class is paired with the bucket's
   smallest only; a pair goes on if its collision-corrected Jaccard estimate is at least
   the threshold less ``slack``, and is then confirmed on the full sets. Components of confirmed links follow.
4. Buckets that still hold several components are searched again for pairs of different components. Members of the
   bucket's largest component and all others are dealt into cells of bounded size; each pair of cells that holds others is one group,
   estimates are compared in numpy, likely pairs are confirmed on the full sets there and then, and only confirmed links are emitted. So no link
   between different components is left out for lack of a pivot, and m members of which o are outside the largest component cost
   m * o comparisons, not m * m.

``layout`` takes, for any percentage, as many registers a band as leave a pair at the threshold outside all bands with a probability of at most MISS:
24 bands of 5 at 85 % (8e-7), 30 of 4 at 80 % (1e-7). ``slack`` is five standard deviations of the estimate at the threshold.
A set of n shingles is most similar to one that adds a single shingle, at n / (n + 1), so only
sets with n * (100 - percent) < percent can be linked by equality alone and are not banded: five or fewer at 85 %, three or fewer at 80 %.

Null and empty texts have no shingles, are linked with nothing and are their own component. Null ids take
no part: their component is null and they are kept. Rows that repeat an id form one component with it, whatever their texts. An empty table gives
no rows. Very long texts form a block of their own. Columns besides id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import BASE, Block, first_of_each, mix, text_blocks, windows
from skerry.llm.components import components
from skerry.llm.shared import Scratch
from skerry.llm.sift import marked

SHINGLE, REGISTERS, MANTISSA = 5, 120, 10
#: Largest probability that a pair at the threshold shares no band.
MISS = 1e-5
#: A cell of a bucket holds about so many classes, and so many shingles, at most.
CELL, CELL_SHINGLES = 1000, 1_000_000
PAIR = "a long, ta long, b long, tb long"
PAIR_NAMES = ["a", "ta", "b", "tb"]
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 2**63, REGISTERS, dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Chance that two different minima share a register, by the mean over leading-zero counts.
COLLISION = 2.0**-MANTISSA / 3


def layout(percent: int) -> tuple[int, int]:
    """Bands and registers a band: the longest bands that miss a pair at the threshold with a probability of at most MISS."""
    if not 10 <= percent <= 100:
        raise ValueError(f"percent must be between 10 and 100: {percent}")
    rows = max(r for r in range(1, REGISTERS + 1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS)
    return REGISTERS // rows, rows


def slack(percent: int) -> float:
    share = percent / 100
    return 5 * (share * (1 - share) / REGISTERS) ** 0.5


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in text order, and each one's text."""
    words, doc, first = b.words(), b.word_doc, b.first_word
    h, at = windows(words, doc, first, SHINGLE)
    owner = doc[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = count[short] > k
            whole[has] = whole[has] * BASE + words[first[short[has]] + k]
        h, owner = np.r_[h, mix(whole + count[short].astype(np.uint64))], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    one = first_of_each(mix(h + owner.astype(np.uint64) * _GOLDEN))
    return h[one], owner[one]


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the leading one, in 16 bits."""
    top = least.astype(np.float64)
    zeros = 63 - np.minimum(np.maximum(np.frexp(np.maximum(top, 1.0))[1] - 1, 0), 63)
    shifted = least << np.minimum(zeros + 1, 63).astype(np.uint64)
    return ((np.minimum(zeros, 63).astype(np.uint64) << np.uint64(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def sketch_block(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two fingerprints, registers (texts x REGISTERS; zero for an empty set)."""
    h, owner = shingles(b)
    size = np.bincount(owner, minlength=b.docs)
    print_a, print_b = np.zeros(b.docs, np.uint64), np.zeros(b.docs, np.uint64)
    registers = np.zeros((b.docs, REGISTERS), np.uint16)
    full = np.flatnonzero(size)
    if len(full):
        at = np.searchsorted(owner, full)
        print_a[full] = np.add.reduceat(mix(h), at)
        print_b[full] = np.add.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), at)
        least = np.empty((REGISTERS, len(full)), np.uint64)
        for j in range(REGISTERS):
            v = h * _A[j]
            v ^= v >> np.uint64(32)
            v *= _B[j] | np.uint64(1)
            least[j] = np.minimum.reduceat(v, at)
        registers[full] = compress(least).T
    return size, print_a.view(np.int64), print_b.view(np.int64), registers


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from equal registers, less those that chance makes equal."""
    return ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in text_blocks(batch.column(1)):
            size, x, y, registers = sketch_block(b)
            raw = pa.array([r.tobytes() for r in registers], pa.binary())
            own = [batch.column(k).slice(b.first, b.docs) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(x), pa.array(y), raw], ["id", "th", "n", "fa", "fb", "sketch"])


def _band_keys(bands: int, rows: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.arange(bands, dtype=np.uint64)[None, :] * _GOLDEN
            for k in range(rows):
                key = mix(key + r[:, :, k] + np.uint64(1))
            own = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), bands)) for k in (0, 1, 3)]
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(key.reshape(-1).view(np.int64)), own[2], pa.array(band)], ["id", "th", "bucket", "n", "band"])

    return keys


def _likely(percent: int):
    least = percent / 100 - slack(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            good = pa.array(estimate(a, b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(4)], PAIR_NAMES)

    return keep


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (bucket, x, y) after another, from a stream sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        cut = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            key = keys[:, s].tolist()
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(pa.Table.from_batches([batch.slice(s, e - s)]))
    if held:
        yield pa.concat_tables(held)


def _cell_pairs(cell: pa.Table, percent: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Row pairs of different components that may be linked, and their estimates. A pair counts in the first bucket that it shares only."""
    bands, rows = layout(percent)
    least = percent / 100 - slack(percent)
    size, comp, side = (cell[c].to_numpy() for c in ("n", "comp", "side"))
    registers = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    banded = registers[:, : bands * rows].reshape(-1, bands, rows)
    key, x, y = (cell[c][0].as_py() for c in ("band", "x", "y"))
    left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
    a, b, how = [], [], []
    for at, i in enumerate(left):
        j = right[at + 1 :] if x == y else right
        j = j[(comp[j] != comp[i]) & (percent * np.maximum(size[j], size[i]) <= 100 * np.minimum(size[j], size[i]))]
        if not len(j):
            continue
        likely = estimate(registers[j], registers[i])
        good = likely >= least
        if key and good.any():
            good &= ~(banded[j, :key] == banded[i, :key]).all(axis=2).any(axis=1)
        if good.any():
            a.append(np.full(int(good.sum()), i)), b.append(j[good]), how.append(likely[good])
    return a, b, np.concatenate(how) if how else np.zeros(0)


def _active(percent: int):
    """Rows of a cell that have a pair to confirm in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            if cell.num_rows > 1:
                a, b, _ = _cell_pairs(cell, percent)
                if a:
                    rows = cell.take(pa.array(np.unique(np.concatenate([*a, *b])))).combine_chunks()
                    yield from rows.to_batches()

    return find


def _link_cells(percent: int):
    """Confirms a cell's pairs on full sets, likeliest first, and gives their components as edges; pairs that the cell has already joined are passed over."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            a, b, how = _cell_pairs(cell, percent)
            if not a:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in cell["set"].to_pylist()]
            comp = cell["comp"].to_numpy()
            up: dict[int, int] = {}

            def top(c: int, up: dict[int, int] = up) -> int:
                while c in up:
                    c = up[c]
                return c

            order = np.argsort(-how, kind="stable")
            u, v = [], []
            for i, j in zip(np.concatenate(a)[order].tolist(), np.concatenate(b)[order].tolist(), strict=True):
                ci, cj = top(int(comp[i])), top(int(comp[j]))
                if ci == cj:
                    continue
                both = np.sort(np.concatenate((sets[i], sets[j])))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common and 100 * common >= percent * (len(both) - common):
                    up[max(ci, cj)] = min(ci, cj)
                    u.append(comp[i]), v.append(comp[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return link


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in text_blocks(batch.column(2)):
            h, owner = shingles(b)
            cut = np.searchsorted(owner, np.arange(b.docs + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(b.first, b.docs) for k in (0, 1)), pa.array([h[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "th", "set"])


def _confirm(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch.column(2)):
                other = next(text_blocks(batch.column(3).slice(b.first, b.docs), 1 << 62))
                ha, oa = shingles(b)
                hb, ob = shingles(other)
                na, nb = np.bincount(oa, minlength=b.docs), np.bincount(ob, minlength=b.docs)
                key = np.sort(np.r_[mix(ha + oa.astype(np.uint64) * _GOLDEN), mix(hb + ob.astype(np.uint64) * _GOLDEN)])
                shared = key[1:][key[1:] == key[:-1]]
                key = mix(ha + oa.astype(np.uint64) * _GOLDEN)
                common = np.bincount(oa[np.isin(key, shared)], minlength=b.docs) if len(shared) else np.zeros(b.docs, np.int64)
                good = pa.array((common > 0) & (100 * common >= percent * (na + nb - common)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(b.first, b.docs).filter(good) for k in (0, 1)], ["u", "v"])

    return keep


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents with one of the (id, text hash), which are distinct; repeated rows once.

    Only documents that the map of bits does not rule out are shuffled to the exact join. It is an inner one, as the optimizer would move a semi join below the map's.
    """
    sifted = marked(docs, wanted, ["id", "th"], "maybe").filter("maybe").select(*docs.columns)
    return sifted.join(wanted.hint("merge"), ["id", "th"]).groupBy("id", "th").agg(F.min("text").alias("text"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets are similar enough, as edges between ids."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ta").alias("th")), F.struct(F.col("b").alias("id"), F.col("tb").alias("th"))))
    need = scratch.keep(pairs.select(ends.alias("x")).select("x.*").distinct(), "ids")
    texts = scratch.keep(_only(docs, need), "texts")
    both = pairs
    for k in ("a", "b"):
        both = both.join(texts.select(F.col("id").alias(k), F.col("th").alias(f"t{k}"), F.col("text").alias(f"text_{k}")).hint("merge"), [k, f"t{k}"])
    out = scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "u long, v long"), "links")
    scratch.drop(texts, need, pairs)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; see the module's text."""
    spark, (n_bands, rows) = docs.sparkSession, layout(percent)
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    sketches = scratch.keep(docs.mapInArrow(_sketches, "id long, th long, n long, fa long, fb long, sketch binary"), "sketches")
    real = sketches.filter("n > 0 and id is not null")
    classes = real.groupBy("fa", "fb", "n").agg(F.min(F.struct("id", "th", "sketch")).alias("x")).select("fa", "fb", "n", F.col("x.id").alias("rep"), F.col("x.th").alias("th"), F.col("x.sketch").alias("sketch"))
    classes = scratch.keep(classes, "classes")
    wide = classes.filter(f"n * {100 - percent} >= {percent}").select(F.col("rep").alias("id"), "th", "sketch", "n")
    bands = scratch.keep(wide.mapInArrow(_band_keys(n_bands, rows), "id long, th long, bucket long, n long, band int"), "bands")
    buckets = bands.groupBy("bucket").agg(F.min(F.struct("id", "th")).alias("pivot"), F.count("*").alias("m")).filter("m > 1")
    members = scratch.keep(bands.join(buckets, "bucket").select("bucket", "band", "id", "th", "n", F.col("pivot.id").alias("a"), F.col("pivot.th").alias("ta")), "members")
    scratch.drop(bands)
    star = members.filter("id <> a or th <> ta").select("a", "ta", F.col("id").alias("b"), F.col("th").alias("tb")).distinct()

    def likely(pairs: DataFrame) -> DataFrame:
        for k in ("a", "b"):
            pairs = pairs.join(wide.select(F.col("id").alias(k), F.col("th").alias(f"t{k}"), F.col("sketch").alias(f"s{k}")), [k, f"t{k}"])
        return pairs.select(*PAIR_NAMES, "sa", "sb").mapInArrow(_likely(percent), PAIR)

    links = _confirmed(scratch.keep(likely(star), "pairs"), docs, percent, scratch)
    # Rows of one id with different sets are one document.
    twice = scratch.keep(real.groupBy("id").agg(F.min("fa").alias("lo"), F.max("fa").alias("hi")).filter("lo <> hi").select("id"), "twice")
    if not twice.isEmpty():
        own = real.join(twice, "id", "left_semi").join(classes.select("fa", "fb", "n", "rep"), ["fa", "fb", "n"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
        links = links.union(scratch.keep(own, "same"))
    comps = scratch.keep(components(links, scratch), "comps")

    # Pairs of different components that share a bucket.
    placed = members.join(comps.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", "th", "n", F.coalesce("component", "id").alias("comp"))
    groups = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    cells = lambda m, w: F.ceil(F.greatest(m / CELL, w / CELL_SHINGLES)).cast("int")
    open_buckets = groups.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("m", "w", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w")).filter("k > 1")
    rest = (F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w"))
    open_buckets = open_buckets.select("bucket", F.col("top.comp").alias("largest"), cells(*rest).alias("few"), cells(F.col("top.m"), F.col("top.w")).alias("many"))
    inside, hashed = F.col("comp") == F.col("largest"), F.xxhash64("id", "th", "bucket")
    side = F.when(inside, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    dealt = placed.join(open_buckets, "bucket").select("bucket", "band", "id", "th", "n", "comp", side.alias("side"), others.alias("other")).join(wide.select("id", "th", "sketch"), ["id", "th"])
    dealt = dealt.select("bucket", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "band", "id", "th", "n", "comp", "side", "sketch")
    kind = "bucket long, x int, y int, band int, id long, th long, n long, comp long, side int, sketch binary"

    def by_cell(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    active = scratch.keep(by_cell(dealt).mapInArrow(_active(percent), kind), "active")
    need = scratch.keep(active.select("id", "th").distinct(), "ids")
    sets = _only(docs, need).select("id", "th", "text").mapInArrow(_sets, "id long, th long, set binary")
    second = scratch.keep(by_cell(active.join(sets, ["id", "th"]).select(*active.columns, "set")).mapInArrow(_link_cells(percent), "u long, v long"), "links")
    scratch.drop(active, need, members)
    joined = scratch.keep(components(second, scratch), "joined")
    scratch.drop(second)
    near = classes.select("fa", "fb", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", "n", F.coalesce("component", "rep").alias("node"))
    reps = near.join(joined, "node", "left").select("fa", "fb", "n", F.coalesce("component", "node").alias("c"))
    out = sketches.select("id", "n", "fa", "fb").join(reps, ["fa", "fb", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


WORDS_SQL = "list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(u, v) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN c ON c.u = s.doc_id
"""
