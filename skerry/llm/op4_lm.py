"""Language-model scoring: exact add-one unigram counts of all training texts, and a log-bilinear neural model over the whole vocabulary.

Tokens are A-Z lower-cased words, then one end. From the two tokens before, ``q = R[w1] C1 + R[w2] C2``. A known word's probability is

    P(w | w1, w2) = u(w) exp(q . r(w) + b(w)) / Z,    u(w) = (c(w) + 1) / (N + V + 1)

``r(w)`` is a row of its own for the end and for every word that has at least one in FREQUENT training tokens, however many those are (they cannot be more than FREQUENT).
Every other word's is the sum of two rows: that of its beginning (first two bytes, BEGINNINGS hashed classes) and that of its ending (last three bytes, ENDINGS classes).
So each known word has a vector, and Z is exact over the whole vocabulary however large: the words of rows of their own add up one by one, the others
as ``a' M e`` with a and e the exponentials of beginnings and endings and M the summed u of the words of each pair. One unknown word has u = 1 / (N + V + 1)
and factor 1. As a context, a word without a row of its own stands by its ending.

R, C and b are trained in numpy by noise-contrastive estimation over every training text, with noise from u: each task takes one AdaGrad pass over its
texts from common parameters, and parameters are averaged by tokens; ``rounds`` such passes, at a falling rate. Scoring takes batched matrix products over a chunk's different contexts.

Counts never meet on the driver. Texts are tokenised once, into chunks of ``chunk_bytes`` at most (a longer text is a chunk by itself): a chunk's different words, their training
counts, and each token's place among them. A word of one chunk alone has that chunk's count, so only counts of words of several go back to chunks. Chunks follow the order of rows within a task, so repeated rows, null ids and hot sources are spread like any others.
Words are combined per chunk before the shuffle, counted by word, and joined back to the chunks. Words with rows of their own are sent along instead of joined, so no join
key is in more than a small share of the rows. Words are told apart by a 64-bit hash.

Null and empty texts are a lone end token. Repeated rows are counted and scored one by one; rows with a null id count as training texts.
With no training texts N and V are 0 and all words are unknown. An empty table gives no rows. Columns besides doc_id, text and held_out are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import BLOCK_BYTES, LOWER, Block, mix, text_blocks
from skerry.llm.op2_toxicity import held_out
from skerry.llm.shared import Scratch

FREQUENT, BEGINNINGS, ENDINGS = 8192, 64, 128
WIDTH, NOISE, BATCH, RATE, ROUNDS = 16, 64, 4096, 0.1, 1
CHUNK_BYTES, SLICE, TOKENS = 6 << 20, 512, 1 << 16
BATCH_LIMIT, PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
END = np.uint64(0x5EED0E4D)
CHUNK = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, codes binary, words binary, counts binary, cells binary"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, a batch sent to Python ends at the row that brings it to PER_BATCH bytes. Without it a batch is a task's whole share, held several times over beside the heap."""
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, str(PER_BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)


def forms(b: Block) -> np.ndarray:
    """Each word's pair of beginning and ending, as one number."""
    data = LOWER[b.data].astype(np.uint64)
    size = b.end - b.start
    at = lambda place, has: np.where(size > has, data[np.where(size > has, place, 0)], np.uint64(0)) if len(data) else np.zeros(0, np.uint64)
    first = mix(at(b.start, 0) * np.uint64(257) + at(b.start + 1, 1)) % np.uint64(BEGINNINGS)
    last = mix((at(b.end - 1, 0) * np.uint64(257) + at(b.end - 2, 1)) * np.uint64(257) + at(b.end - 3, 2)) % np.uint64(ENDINGS)
    return (first * np.uint64(ENDINGS) + last).astype(np.uint16)


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of all texts' tokens with the ends, and the number of tokens of each text."""
    size = np.diff(b.first_word) + 1
    word = np.arange(len(b.word_doc)) + b.word_doc
    h, cell = np.full(int(size.sum()), END, np.uint64), np.zeros(int(size.sum()), np.uint16)
    h[word], cell[word] = b.words(), forms(b)
    return h, cell, size


def _pack(codes: np.ndarray, different: int) -> bytes:
    """Byte planes, as upper ones are mostly zero and compress well."""
    planes = 3 if different < 1 << 24 else 4
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    planes = len(raw) // n
    out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view("<i4").ravel()


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            ids, flags = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
            h, cell, size = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            codes, different = pd.factorize(h)
            times = np.bincount(codes, minlength=len(different))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes, different = place[codes], different[order]
            counts = np.bincount(codes, np.repeat(~flags.to_numpy(zero_copy_only=False), size), minlength=len(different)).astype("<i4")
            form = np.zeros(len(different), "<u2")
            form[codes] = cell
            row = [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, flags, pa.array(size, pa.int32())))]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([x], pa.binary()) for x in (_pack(codes, len(different)), different.astype("<u8").tobytes(), counts.tobytes(), form.tobytes()))], ["chunk", "ids", "held", "sizes", "codes", "words", "counts", "cells"])

        for batch in batches:
            for b in text_blocks(batch.column(1), min(limit, BLOCK_BYTES)):
                if held and used + len(b.data) > limit:
                    yield close()
                    held, used, number = [], 0, number + 1
                held.append((*(batch.column(k).slice(b.first, b.docs) for k in (0, 2)), *tokens(b)))
                used += len(b.data)
        if held:
            yield close()

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts, cells in zip(*(batch.column(k) for k in range(4)), strict=True):
            h = np.frombuffer(words.as_buffer(), np.int64)
            n = np.frombuffer(counts.as_buffer(), np.int32)
            cell = np.frombuffer(cells.as_buffer(), np.uint16).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk.as_py(), np.int64)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h), pa.array(n), pa.array(cell)], ["chunk", "pos", "h", "n", "cell"])


@dataclass
class Vocabulary:
    """What the driver knows of the training words: the totals, the words with rows of their own, and sums over the others' forms; all of bounded size."""

    total: int
    types: int
    words: np.ndarray  # hashes in ascending order, without the end
    counts: np.ndarray
    ends: int
    cells: np.ndarray  # BEGINNINGS x ENDINGS: sums of count + 1 over the other words

    @property
    def whole(self) -> int:
        return self.total + self.types + 1

    def own(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the words with rows of their own, and whether they are there."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


class LogBilinear:
    """Rows of R: the words with rows of their own, the end (which also stands before a text), beginnings, endings, and one of zeros."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.end = len(v.words)
        self.first, self.last, self.zero = self.end + 1, self.end + 1 + BEGINNINGS, self.end + 1 + BEGINNINGS + ENDINGS
        rng = np.random.default_rng(5)
        self.parts = {"R": rng.normal(0, 0.1, (self.zero + 1, WIDTH)), "C1": np.eye(WIDTH) * 0.5, "C2": np.eye(WIDTH) * 0.2, "b": np.zeros(self.zero + 1)}
        self.parts = {k: x.astype(np.float32) for k, x in self.parts.items()}
        self.parts["R"][self.zero] = 0
        i, j = np.nonzero(v.cells)
        self.noise_rows = np.concatenate((np.arange(self.end + 1), self.first + i)), np.concatenate((np.full(self.end + 1, self.zero), self.last + j))
        share = np.concatenate((v.counts + 1, [v.ends + 1 if v.ends else 0], v.cells[i, j])).astype(float)
        self.noise = np.cumsum(share) / max(share.sum(), 1)

    def own(self, h: np.ndarray) -> np.ndarray:
        """The rows of words that have one of their own, else that of zeros."""
        at, hit = self.vocabulary.own(h)
        return np.where(h == END, self.end, np.where(hit, at, self.zero))

    def rows(self, own: np.ndarray, cell: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two target rows of words, and the one that they have as a context."""
        hit, cell = own != self.zero, cell.astype(np.int64)
        one = np.where(hit, own, self.first + cell // ENDINGS)
        two = np.where(hit, self.zero, self.last + cell % ENDINGS)
        context = np.where(hit, own, two)
        if known is not None:
            one[~known], two[~known] = self.zero, self.zero
        return tuple(x.astype(np.int32) for x in (one, two, context))

    def before(self, context: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context rows one and two tokens before; ends stand before a text."""
        one, two = np.full(len(context), self.end, np.int32), np.full(len(context), self.end, np.int32)
        one[1:], two[2:] = context[:-1], context[:-2]
        begin = np.cumsum(sizes) - sizes
        one[begin], two[begin] = self.end, self.end
        two[begin[sizes > 1] + 1] = self.end
        return one, two

    def learn(self, stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE) -> int:
        """One pass of noise-contrastive estimation over (target rows, context rows); returns the tokens seen."""
        p = {k: v.copy() for k, v in self.parts.items()}
        squares = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}
        rng, n, seen, fair = np.random.default_rng(6), self.zero + 1, 0, np.float32(np.log(NOISE))

        for columns in stream:
            batches = -(-len(columns[0]) // BATCH)
            for s in range(batches):  # every so manieth token, so that a batch has tokens of the whole chunk
                a, z, w1, w2 = (c[s::batches] for c in columns)
                drawn = np.minimum(np.searchsorted(self.noise, rng.random(NOISE), "right"), len(self.noise) - 1)
                na, nz = (r[drawn] for r in self.noise_rows)
                e1, e2, target, other = p["R"][w1], p["R"][w2], p["R"][a] + p["R"][z], p["R"][na] + p["R"][nz]
                q = e1 @ p["C1"] + e2 @ p["C2"]
                good = np.einsum("ij,ij->i", q, target)
                good += p["b"][a] + p["b"][z] - fair
                dg = -1 / (1 + np.exp(np.minimum(good, 80)))
                db = q @ other.T
                db += p["b"][na] + p["b"][nz] - fair
                np.maximum(db, -80, out=db)
                np.negative(db, out=db)
                np.exp(db, out=db)
                db += 1
                np.reciprocal(db, out=db)
                dq = dg[:, None] * target
                dq += db @ other
                up = (dg[:, None] * q).T
                by_row = np.concatenate((up, up, p["C1"] @ dq.T, p["C2"] @ dq.T), axis=1)
                rows, away, bias = np.concatenate((a, z, w1, w2)), db.T @ q, np.ones(len(a), np.float32) @ db
                r = np.stack([np.bincount(rows, x, minlength=n) for x in by_row], axis=1).astype(np.float32)
                b = np.bincount(rows[: 2 * len(a)], np.concatenate((dg, dg)), minlength=n).astype(np.float32)
                for k in (na, nz):
                    np.add.at(r, k, away)
                    np.add.at(b, k, bias)
                r[self.zero], b[self.zero] = 0, 0
                for k, g in (("R", r), ("b", b), ("C1", e1.T @ dq), ("C2", e2.T @ dq)):
                    g /= len(a)
                    squares[k] += g * g
                    p[k] -= rate * g / np.sqrt(squares[k])
            seen += len(columns[0])
        self.parts = p
        return seen

    def log_z(self, q: np.ndarray) -> np.ndarray:
        """Natural log of Z for each context vector; summands are clipped to exp(-60) to exp(60) times their u, as in :meth:`log_factor`."""
        p, v = self.parts, self.vocabulary
        own = (np.concatenate((v.counts + 1, [v.ends + 1 if v.ends else 0])) / v.whole).astype(np.float32)
        cells, out = (v.cells / v.whole).astype(np.float32), np.empty(len(q))
        r, most = np.ascontiguousarray(p["R"][: self.zero].T), np.abs(p["R"]).sum(1).max()
        for s in range(0, len(q), SLICE):
            part = q[s : s + SLICE]
            g = part @ r
            g += p["b"][: self.zero]
            if np.abs(part).max() * most + np.abs(p["b"]).max() > 30:
                np.clip(g, -30, 30, out=g)
            np.exp(g, out=g)
            z = g[:, : self.first] @ own
            z += np.einsum("ij,ij->i", g[:, self.first : self.last] @ cells, g[:, self.last :])
            out[s : s + SLICE] = np.log(z + 1 / v.whole)
        return out

    def log_factor(self, q: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """q . r(w) + b(w), row by row."""
        p = self.parts
        one, two = (np.clip(np.einsum("ij,ij->i", q, p["R"][r]) + p["b"][r], -30, 30) for r in (a, z))
        return one.astype(np.float64) + two

    def log_prob(self, log_u: np.ndarray, a: np.ndarray, z: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability given its context; ``log_u``: that of its u."""
        n, (first, second) = self.zero + 1, (self.parts["R"] @ self.parts[k] for k in ("C1", "C2"))
        code, different = pd.factorize(one * n + two)
        log_z, out = np.empty(len(different)), np.empty(len(code))
        for s in range(0, len(different), TOKENS):
            i = slice(s, s + TOKENS)
            log_z[i] = self.log_z(first[different[i] // n] + second[different[i] % n])
        for s in range(0, len(code), TOKENS):
            i = slice(s, s + TOKENS)
            out[i] = log_u[i] - log_z[code[i]] + self.log_factor(first[one[i]] + second[two[i]], a[i], z[i])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[k].ravel() for k in ("R", "C1", "C2", "b")])

    def unflatten(self, x: np.ndarray) -> None:
        for k in ("R", "C1", "C2", "b"):
            size = self.parts[k].size
            self.parts[k], x = x[:size].reshape(self.parts[k].shape).astype(np.float32), x[size:]


def _pass(model: LogBilinear, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for flags, sizes, codes, words, cells in zip(*(batch.column(k) for k in range(5)), strict=True):
                    flags, sizes = flags.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy()
                    code = _unpack(codes.as_buffer(), int(sizes.sum()))
                    a, z, context = (r[code] for r in model.rows(model.own(np.frombuffer(words.as_buffer(), np.uint64)), np.frombuffer(cells.as_buffer(), np.uint16)))
                    keep = np.repeat(~flags, sizes)
                    yield tuple(x[keep] for x in (a, z, *model.before(context, sizes)))

        start = {k: v.copy() for k, v in model.parts.items()}
        seen = model.learn(stream(), rate)
        x = model.flat().astype(np.float64)
        model.parts = start
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * seen), pa.array(np.full(len(x), float(seen)))], ["i", "x", "w"])

    return run


def _placed(model: LogBilinear):
    """Chunks whose words are replaced by their own rows: a quarter of the bytes to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k = names.index("words")
            own = [model.own(np.frombuffer(x.as_buffer(), np.uint64)).astype("<u2").tobytes() for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()) if i == k else c for i, c in enumerate(batch.columns)], names)

    return run


def _score(model: LogBilinear):
    v = model.vocabulary
    often = np.concatenate((v.counts, [v.ends]))

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        where, times = counts["pos"].to_numpy(), counts["c"].to_numpy()
        for ids, flags, sizes, codes, words, here, cells in zip(*(rows[c].combine_chunks() for c in ("ids", "held", "sizes", "codes", "words", "counts", "cells")), strict=True):
            size = sizes.values.to_numpy()
            code, own = _unpack(codes.as_buffer(), int(size.sum())), np.frombuffer(words.as_buffer(), "<u2").astype(np.int64)
            c = np.frombuffer(here.as_buffer(), np.int32).astype(np.int64)
            c[where] = times
            hit = own != model.zero
            c[hit] = often[own[hit]]
            a, z, context = model.rows(own, np.frombuffer(cells.as_buffer(), np.uint16), c > 0)
            one, two = model.before(context[code], size)
            log_u = np.log((c + 1) / v.whole)[code]
            lp = model.log_prob(log_u, a[code], z[code], one, two) / np.log(10)
            begin = np.cumsum(size) - size
            add = lambda x: np.add.reduceat(x, begin)
            columns = [ids.values, flags.values, size.astype(np.int64), add((c > 0)[code].astype(np.int64)), np.full(len(size), v.total, np.int64), add(np.log10((c + 1) / v.whole)[code]), add(lp)]
            out.append(pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        if not out:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.table([pa.array([], k) for k in kinds], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pa.concat_tables(out)

    return run


class Corpus:
    """Tokenised texts and their word counts in the shared folder."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "lm")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
        with small_batches(self.spark):
            self.chunks = self.scratch.keep(rows.mapInArrow(_chunks(chunk_bytes), CHUNK), "chunks")
        self.words = self.chunks.select("chunk", "words", "counts", "cells").mapInArrow(_words, "chunk long, pos int, h long, n int, cell int")
        with small_batches(self.spark):
            self.counts = self.scratch.keep(self.words.groupBy("h").agg(F.sum("n").alias("c"), F.min("cell").alias("cell"), F.count("*").alias("k")).filter("c > 0"), "counts")

    def vocabulary(self, frequent: int = FREQUENT) -> Vocabulary:
        if not 1 <= frequent <= 1 << 15:
            raise ValueError(f"frequent must be between 1 and 32,768: {frequent}")
        total, types = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        end = int(END.astype(np.int64))
        ends = next((r["c"] for r in self.counts.filter(f"h = {end}").collect()), 0)
        top = self.counts.filter(f"h <> {end} and c * {frequent} >= {total}").collect()  # at most ``frequent`` words can have so large a share
        order = np.argsort(np.array([r["h"] for r in top], np.int64).view(np.uint64))
        words, counts = (np.array([r[k] for r in top], np.int64)[order] for k in ("h", "c"))
        others = self.counts.filter(f"h <> {end} and c * {frequent} < {total}")
        cells = np.zeros((BEGINNINGS, ENDINGS))
        for r in others.groupBy("cell").agg(F.sum(F.col("c") + 1).alias("s")).collect():
            cells[r["cell"] // ENDINGS, r["cell"] % ENDINGS] = r["s"]
        return Vocabulary(total, types, words.view(np.uint64), counts, ends, cells)

    def fit(self, vocabulary: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
        model = LogBilinear(vocabulary)
        for k in range(rounds if vocabulary.total else 0):
            moved = self.chunks.select("held", "sizes", "codes", "words", "cells").mapInArrow(_pass(model, RATE / (k + 1)), "i int, x double, w double")
            with small_batches(self.spark):
                got = moved.groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toPandas()  # one row a parameter
            if len(got):
                model.unflatten(got.sort_values("i")["x"].to_numpy())
        return model

    def score(self, model: LogBilinear) -> DataFrame:
        own = np.concatenate((model.vocabulary.words, [END])).astype(np.uint64).view(np.int64)
        sent = self.spark.createDataFrame([(int(x),) for x in own], "h long")
        mine = self.words.select("chunk", "pos", "h", "n").join(F.broadcast(sent), "h", "left_anti").join(self.counts.filter("k > 1").select("h", "c"), "h").filter("c <> n").select("chunk", "pos", "c")
        kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        scored = self.chunks.mapInArrow(_placed(model), CHUNK).groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(_score(model), kind)
        with small_batches(self.spark):  # run here, as the caller's plan would run without it
            return self.scratch.keep(scored, "scores")


def score_texts(docs: DataFrame, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """``docs``: doc_id, text, held_out. Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    corpus = Corpus(docs)
    return corpus.score(corpus.fit(corpus.vocabulary(frequent), rounds))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    return score_texts(docs)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's own columns as far as SQL can express them."""
    return op4_lm(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: Held-out rows have a crc32 of 2 modulo 7. DuckDB has no crc32, so it is written out bit by bit over the id's digits.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
BASE_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(xor({_CRC}, 4294967295) % 7 = 2, false) AS held,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, held, unnest(ws) AS x FROM w),
c AS MATERIALIZED (SELECT x, count(*) AS n FROM t WHERE NOT held GROUP BY x),
s AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS types FROM c)
SELECT doc_id, count(*) AS n_tokens, count(n) AS n_known, max(total) AS train_tokens, round(sum(log10((coalesce(n, 0) + 1) / (total + types + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (x), s GROUP BY doc_id
"""
