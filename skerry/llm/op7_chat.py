"""Chat formatting as a prefix tree.

A turn is written ``<s>role[INST]text[/INST]</s>``. Roles and texts are escaped (``\\`` as ``\\\\``, ``<`` as ``\\l``, ``[`` as ``\\b``), so no
control string can occur in them, and tokenised apart from the control strings by a byte-level tokenizer: node by node, so shared turns have the same tokens.

Each conversation has the chain of its turns' prefix hashes as a key. Conversations are range-sorted by that key, which is the depth-first order of the tree:
all that share initial turns stand together. One stream a partition then walks the tree: what a conversation shares with the one
before is not written again. A sequence ends where the first turn changes, where it would pass ``max_tokens``, or where a partition ends; the shared turns
are then written once more in the next. So a first turn that a third of all conversations share is spread over many
partitions, and memory holds one sequence. Each node has its position (as if its conversation stood alone) and the intervals of its
ancestors' tokens, which its tokens attend to besides the node's own earlier tokens.

Rows are ordered by turn, then role and text; repeated rows are turns of their own. Null role and text count as empty, null turns come first, and rows with a null
conv_id form one conversation with a null id. An empty table gives no sequences. A conversation is one record and is held in memory whole.
Columns besides conv_id, turn, role and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS, LEARNED_ROLE, CONTROLS, BATCH_TOKENS = 65_536, "assistant", 4096, 1 << 19
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>"
TURN = re.compile(r"<s>([^<\[]*)\[INST\]([^<\[]*)\[/INST\]</s>")
ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
UNESCAPE = {v: k for k, v in ESCAPE.items()}
NODE = "struct<start:int,end:int,position:int,learn_start:int,learn_end:int,before:array<struct<start:int,end:int>>>"
SEQUENCE = f"tokens array<int>, positions array<int>, nodes array<{NODE}>, conv_ids array<bigint>, leaves array<int>"


def escape(s: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: ESCAPE[m[0]], s)


def unescape(s: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: UNESCAPE[m[0]], s)


class Tokens:
    _open: dict[str, Tokens] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: The printable bytes of Latin-1 stand for themselves in a byte-level vocabulary, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.control = lru_cache(CONTROLS)(lambda s: self.encode([s])[0])

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode(errors="replace")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for turns in batch.column(1).to_pylist():
            chain, key = b"", []
            for t in turns:
                role, text = (t["role"] or "").encode(), (t["text"] or "").encode()
                chain = hashlib.blake2b(chain + len(role).to_bytes(8, "little") + role + text, digest_size=12).digest()
                key.append(chain)
            keys.append(b"".join(key))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["conv_id", "turns", "path"])


def _walk(path: str, max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens.of(path)
        names = ["tokens", "positions", "nodes", "conv_ids", "leaves"]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([*((x, pa.int32()) for x in ("start", "end", "position", "learn_start", "learn_end")), ("before", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])), pa.list_(pa.int64()), pa.list_(pa.int32())]
        tokens: list[int] = []
        positions: list[int] = []
        nodes: list[dict] = []
        ids: list[int | None] = []
        leaves: list[int] = []
        stack: list[tuple[bytes, int]] = []
        done: list[tuple] = []
        waiting = 0

        def spell(turns: list[dict]) -> list[list[int]]:
            bodies = coder.encode([escape(t["text"] or "") for t in turns])
            return [x for t, body in zip(turns, bodies, strict=True) for x in (coder.control(OPEN + escape(t["role"] or "") + MIDDLE), body, coder.control(CLOSE))]

        def close() -> None:
            nonlocal tokens, positions, nodes, ids, leaves, waiting
            if ids:
                done.append((np.array(tokens, np.int32), np.array(positions, np.int32), nodes, ids, leaves))
                waiting += len(tokens)
            tokens, positions, nodes, ids, leaves = [], [], [], [], []
            stack.clear()

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names)
            done.clear()
            waiting = 0

        for batch in batches:
            for conv, turns, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chain = [key[k : k + 12] for k in range(0, len(key), 12)]
                shared = 0
                while shared < min(len(stack), len(chain)) and stack[shared][0] == chain[shared]:
                    shared += 1
                coded = spell(turns[shared:])
                if stack and (not shared or len(tokens) + sum(map(len, coded)) > max_tokens):
                    close()
                    if waiting >= BATCH_TOKENS:
                        yield from emit()
                    if shared:
                        shared, coded = 0, spell(turns)
                del stack[shared:]
                for k in range(shared, len(chain)):
                    head, body, tail = coded[3 * (k - shared) : 3 * (k - shared) + 3]
                    start, position, before = len(tokens), 0, []
                    if stack:
                        up = nodes[stack[-1][1]]
                        position = up["position"] + up["end"] - up["start"]
                        before = [*up["before"]]
                        if before and before[-1]["end"] == up["start"]:
                            before[-1] = {"start": before[-1]["start"], "end": up["end"]}
                        else:
                            before.append({"start": up["start"], "end": up["end"]})
                    tokens += head + body + tail
                    end = len(tokens)
                    positions += range(position, position + end - start)
                    learn = (start + len(head), start + len(head) + len(body)) if turns[k]["role"] == LEARNED_ROLE else (start, start)
                    nodes.append({"start": start, "end": end, "position": position, "learn_start": learn[0], "learn_end": learn[1], "before": before})
                    stack.append((chain[k], len(nodes) - 1))
                ids.append(conv), leaves.append(stack[-1][1])
        close()
        yield from emit()

    return run


def format_trees(rows: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Sequences (SEQUENCE) of ``rows``: conv_id, turn, role, text."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id").agg(turns.alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    keyed = whole.mapInArrow(_keys, "conv_id long, turns array<struct<role:string,text:string>>, path binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_walk(tokenizer_path, max_tokens), SEQUENCE)


def _lists(a: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values of the lists, and where each list starts among them."""
    offsets = a.offsets.to_numpy()
    return a.flatten(), offsets - offsets[0]


def read_back(sequences: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each conversation's digests, from the tokens that its leaf attends to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens.of(tokenizer_path)
        for batch in batches:
            out = []
            (tokens, token_at), (nodes, node_at), (ids, id_at), (leaves, _) = map(_lists, batch.columns)
            fields = {c: nodes.field(c).to_numpy() for c in ("start", "end", "learn_start", "learn_end")}
            before, before_at = _lists(nodes.field("before"))
            spans = list(zip(before.field("start").to_pylist(), before.field("end").to_pylist(), strict=True))
            tokens, ids, leaves = tokens.to_numpy(), ids.to_pylist(), leaves.to_pylist()
            for s in range(batch.num_rows):
                first, row = int(node_at[s]), tokens[token_at[s] : token_at[s + 1]].tolist()
                start, end, learn_start, learn_end = (v[first : int(node_at[s + 1])].tolist() for v in fields.values())
                texts = [coder.decode(row[a:b]) for a, b in zip(start, end, strict=True)]
                learned = [unescape(coder.decode(row[a:b])) for a, b in zip(learn_start, learn_end, strict=True)]
                place = {a: n for n, a in enumerate(start)}
                for i in range(int(id_at[s]), int(id_at[s + 1])):
                    leaf = leaves[i]
                    seen = []
                    for a, b in [*spans[before_at[first + leaf] : before_at[first + leaf + 1]], (start[leaf], end[leaf])]:
                        while a < b:  # an interval is a run of whole nodes
                            seen.append(place[a])
                            a = end[place[a]]
                    text = "".join([texts[n] for n in seen])
                    loss = "".join([learned[n] for n in seen])
                    turns = hashlib.sha256()
                    found = TURN.findall(text)
                    for role, body in found:
                        turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    out.append((ids[i], len(found), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return sequences.select("tokens", "nodes", "conv_ids", "leaves").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return read_back(format_trees(rows.union(extra), path), path)
