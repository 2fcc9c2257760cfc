"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a web token (``eyJ`` and parts joined by dots); a value of 8 or more bytes that stands after ``=`` or ``:`` (any signs but quotes, brackets, commas and
semicolons, no digit needed; up to the next ``&name=``, and in an address up to its ``@``); or a run of 12 or more of ``A-Z a-z 0-9 + / _ -`` that holds a digit, begins like a known key, or changes between upper and lower case four times or more.

The forest, in numpy, sees a candidate's length, character classes and their transitions, entropy, how its letters alternate, the share of it that dictionary words cover, whether it
stands in a path or an address, what glues it to the word before, and its neighbouring words: four runs of letters and digits before it and one after, each with the log-odds of a secret beside
it that training findings gave. No word is listed as good or bad; the dictionary is the whole-word part of a public vocabulary, whose path is a parameter. The forest learns from labelled findings
(before, candidate, after, is_secret), at most ``max_train_rows`` of smallest hash; where the caller has none, ``labelled_findings`` writes a seeded set after public key formats and
common configuration, code, log and address styles. Features are sums over flat byte arrays, so a neighbour or a candidate of any length costs in proportion to its bytes. Scanning is one pass over whole texts without a shuffle.

Null and empty texts have no findings, an empty table gives none. Repeated rows are scanned one by one, null ids are carried along. Very long texts form a block of their own.
Only id and text are read, so other columns' names cannot clash; ``redact`` leaves every other column as it is.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import Block, text_blocks
from skerry.llm.trees import Forest

MAX_TRAIN_ROWS, THRESHOLD, MASK, NEIGHBOURS = 20_000, 0.5, "[SECRET]", 4
CANDIDATE = re.compile(rb"(?P<web>eyJ[\w-]{8,}(?:\.[\w-]+){1,2})|[=:][ \t]?[\"'`]?(?!/{2}|[\w+.-]*://)(?P<value>(?:[^\s\"'`<>(){}\[\],;&]|&(?!\w+=)){8,})|(?P<run>[A-Za-z0-9+/_\-]{12,}(?:={1,2}(?![^\s\"'`,;]))?)")
#: How keys of public services begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk-", "sk_live_", "rk_live_", "AIza", "npm_", "pypi-", "SG.", "eyJ")
KINDS = ((re.compile(r"A[KS]IA[A-Z0-9]{16}$"), "access_key"), (re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[bap]-|sk[-_]|rk_|AIza|npm_|pypi-|SG\.)"), "service_token"), (re.compile(r"eyJ[\w-]+\."), "web_token"), (re.compile(r"[0-9a-fA-F]+$"), "hex"))
_BYTE = np.arange(256)
CLASS = np.full(256, 3)
CLASS[48:58], CLASS[97:123], CLASS[65:91] = 0, 1, 2
HEX = (CLASS == 0) | np.isin(_BYTE | 32, np.frombuffer(b"abcdef", np.uint8)) & (CLASS < 3)
VOWEL = np.isin(_BYTE | 32, np.frombuffer(b"aeiouy", np.uint8)) & (CLASS < 3)
GLUE = b"=:\"'/@"
WIDTH = 30


def dictionary(path: str) -> frozenset[str]:
    """The vocabulary's words of four letters or more."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in vocabulary if w.endswith("</w>") and len(w) >= 8 and w[:-4].isalpha())


def covered(word: str, known: frozenset[str]) -> int:
    """Letters of a run of letters that dictionary words cover, the longest first from each place on."""
    at = total = 0
    while at + 4 <= len(word):
        n = next((n for n in range(min(14, len(word) - at), 3, -1) if word[at : at + n] in known), 0)
        total, at = total + n, at + (n or 1)
    return total


def spans(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each candidate, in order. None crosses a border of texts."""
    raw = b.data.tobytes()
    first, last = [], []
    edge = b.offset.tolist()
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        for m in CANDIDATE.finditer(raw, lo, hi):
            s, e = m.span(m.lastgroup)
            found = raw[s:e]
            if m.lastgroup == "value":
                if b"@" in found and b"://" in raw[max(lo, raw.rfind(b" ", lo, s)) : s]:
                    found = found[: found.index(b"@")]
                found = found.rstrip(b".,:!?")
                e = s + len(found)
            elif m.lastgroup == "run" and not any(c in b"0123456789" for c in found) and not found.startswith(tuple(x.encode() for x in PREFIXES)):
                cases = CLASS[np.frombuffer(found, np.uint8)]
                if np.count_nonzero(cases[1:] + cases[:-1] == 3) < 4:
                    continue
            if e - s >= 8:
                first.append(s), last.append(e)
    return np.array(first, np.int64), np.array(last, np.int64)


def _neighbours(b: Block, first: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], list[list[str]], np.ndarray]:
    """The runs of letters and digits before and after each candidate, and where the nearest one before ends."""
    plain = np.append(CLASS[b.data] < 3, False) | np.append(b.data >= 128, False)
    cut = np.zeros(len(plain), bool)
    cut[b.offset], cut[first], cut[last] = True, True, True
    before = np.concatenate(([False], plain[:-1]))
    start, end = np.flatnonzero(plain & (~before | cut)), np.flatnonzero(before & (~plain | cut))
    doc = np.searchsorted(b.offset, first, "right") - 1
    raw, low, high = b.data.tobytes(), b.offset[doc], b.offset[doc + 1]
    at, after = np.searchsorted(end, first, "right"), np.searchsorted(start, last)
    text = lambda k: raw[start[k] : min(end[k], start[k] + 40)].decode("utf-8", "replace").lower() + ("\u2026" if end[k] - start[k] > 40 else "")  # noqa: E731  no training word is so long
    left = [[text(k) for k in range(max(0, a - NEIGHBOURS), a) if start[k] >= lo] for a, lo in zip(at.tolist(), low.tolist(), strict=True)]
    right = [[text(k)] if k < len(start) and start[k] < hi else [] for k, hi in zip(after.tolist(), high.tolist(), strict=True)]
    near = np.where(at > 0, end[np.maximum(at, 1) - 1] if len(end) else 0, 0)
    return left, right, np.maximum(near, low)


@dataclass
class Scanner:
    """A fitted forest with the dictionary and the words' log-odds that its features need."""

    known: frozenset[str]
    odds: dict[str, float]
    forest: Forest

    def features(self, b: Block, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = len(first)
        if not n:
            return np.zeros((0, WIDTH))
        sums = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        share = lambda s, e=last, f=first: (s[e] - s[f]) / np.maximum(e - f, 1)
        kind, size = CLASS[b.data], last - first
        letter, vowel = (kind == 1) | (kind == 2), VOWEL[b.data]
        change = np.concatenate(([False], kind[1:] != kind[:-1]))
        alternate = np.concatenate(([False], letter[1:] & letter[:-1] & (vowel[1:] != vowel[:-1])))
        inner = lambda s: (s[last] - s[first + 1]) / np.maximum(size - 1, 1)
        cand = np.repeat(np.arange(n), size)
        byte = b.data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        counts = np.bincount(cand * 256 + byte, minlength=n * 256).reshape(n, 256) / size[:, None]
        entropy = -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(1)
        left, right, near = _neighbours(b, first, last)
        raw = b.data.tobytes()
        names = [raw[s:e] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
        cover = [sum(covered(w, self.known) for w in re.findall(r"[a-z]{4,}", x.decode("utf-8", "replace").lower())) / len(x) for x in names]
        word = np.searchsorted(b.start, first, "right") - 1
        begin = np.minimum(b.start[np.maximum(word, 0)], first) if len(b.start) else first
        slash, colon, dot = (sums(b.data == x) for x in b"/:.")
        scheme = sums(np.concatenate(((b.data[:-2] == 58) & (b.data[1:-1] == 47) & (b.data[2:] == 47), [False, False])) if len(b.data) > 2 else np.zeros(len(b.data), bool))
        space = sums((b.data == 32) | (b.data == 9) | (b.data == 10))
        follow = np.append(b.data, 32)[np.minimum(last, len(b.data))]
        score = [[self.odds.get(w, 0.0) for w in x] or [0.0] for x in left]
        columns = [size, *(share(sums(kind == k)) for k in range(4)), inner(sums(change)), inner(sums(alternate)), share(sums(HEX[b.data])), share(sums(vowel)) / np.maximum(share(sums(letter)), 0.01), entropy, entropy / np.log2(np.maximum(size, 2)), counts.max(1), np.array(cover)]
        columns += [slash[last] - slash[first], colon[last] - colon[first], dot[last] - dot[first], slash[first] - slash[begin], scheme[first] - scheme[begin], space[first] - space[near], first - near]
        columns += [(s[first] - s[near] > 0) for s in (sums(b.data == x) for x in GLUE)]
        columns += [np.isin(follow, np.frombuffer(b"./@", np.uint8)), np.array([x.startswith(tuple(p.encode() for p in PREFIXES)) for x in names]), np.array([max(x) for x in score]) + np.array([min(x) for x in score]), np.array([x[-1] for x in score])]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)

    def scan(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Text, first byte, last byte and score of each finding, and its kind."""
        first, last = spans(b)
        doc = np.searchsorted(b.offset, first, "right") - 1
        raw = b.data.tobytes()
        kinds = [next((k for p, k in KINDS if p.match(x)), "mixed") for x in (raw[s:e].decode("utf-8", "replace") for s, e in zip(first.tolist(), last.tolist(), strict=True))]
        own = np.unique(doc)  # features are computed over the texts that hold candidates
        edge = np.concatenate(([0], np.cumsum(b.offset[own + 1] - b.offset[own])))
        part = Block(0, np.concatenate([b.data[b.offset[d] : b.offset[d + 1]] for d in own.tolist()]), edge) if len(own) else b
        move = (edge[:-1] - b.offset[own])[np.searchsorted(own, doc)] if len(own) else 0
        return doc, first, last, self.forest.predict(self.features(part, first + move, last + move)), kinds


def labelled_findings(n: int = 6000, seed: int = 2) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Seeded examples after public formats, half of them secrets: (before, candidate, after)."""
    rng = np.random.default_rng(seed)
    one = lambda *x: x[int(rng.integers(len(x)))]
    pick = lambda chars, low, high: "".join(rng.choice(list(chars), rng.integers(low, high + 1)))
    digits, hexes, lower = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed, signs = lower + lower.upper() + digits, "!#$%^&*?"
    say = lambda: pick(lower, 2, 9)
    prose = lambda k: " ".join(say() for _ in range(rng.integers(0, k)))
    known = ("server", "release", "update", "station", "garden", "letter", "market", "window", "number", "public", "report", "simple", "travel", "winter", "yellow", "master", "branch", "default", "service", "profile")
    ident = lambda: one("_", "-", "").join(one(*known) for _ in range(rng.integers(2, 5)))
    name = lambda: one("", "", f"{one(*known)}_", "db_", "app.", "MY_") + one("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "client_secret", "access_token", "auth", "private_key", "credentials", "passphrase", "SECRET_KEY", "AUTH_TOKEN", "DB_PASSWORD")
    other = lambda: one("commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "revision", "id", "uuid", "trace", "request_id", "build", "version", "file", "path", "url", "title", "image", "note", "author", "name", "type", "class", "color", "date", "order", "isbn", "ref")
    glue = lambda: one("=", " = ", ": ", ":", '="', ' = "', "='", '": "', ": '", " ")
    close = lambda g: ('"' if g.endswith('"') else "'" if g.endswith("'") else "") + one("", "\n", " ", ", ", ";") + prose(3)
    out, label = [], []
    for k in range(n):
        g, head = glue(), one(prose(4) + " ", "\n", "export ", "  ", "- ", '{"', "const ", "set ")
        if k % 2:
            kind = int(rng.integers(0, 9))
            body = [pick(hexes, 16, 64), pick(mixed, 16, 48), pick(mixed + "+/", 20, 44) + one("", "=", "=="), pick(mixed + signs, 8, 20), pick(lower.upper(), 1, 1) + pick(lower, 4, 8) + pick(digits, 2, 4) + pick(signs, 1, 2) + pick(lower, 0, 3), one("AKIA", "ASIA") + pick(lower.upper() + "234567", 16, 16), one("ghp_", "gho_", "glpat-", "xoxb-", "sk-", "sk_live_", "AIza", "npm_") + pick(mixed, 20, 40), "eyJ" + pick(mixed, 12, 40) + "." + pick(mixed + "_-", 20, 60) + "." + pick(mixed + "_-", 20, 43), pick(mixed, 8, 14)][kind]
            bare = kind in (5, 6, 7) and rng.random() < 0.5
            if kind == 8 and rng.random() < 0.5:
                out.append((f"{prose(3)} {one('postgres', 'https', 'ftp', 'amqp', 'redis')}://{say()}:", body, f"@{say()}.{say()}/{say()}"))
            elif rng.random() < 0.08:
                out.append((f"{prose(3)} Authorization: {one('Bearer', 'Basic', 'token')} ", pick(mixed + "-_", 20, 60), close("")))
            else:
                out.append(((head + prose(3) + " ") if bare else f"{head}{name()}{one(':', '=', ': ', ' = ') if g == ' ' else g}", body, close("" if bare else g)))
        else:
            kind = int(rng.integers(0, 14))
            uuid = "-".join(pick(hexes, m, m) for m in (8, 4, 4, 4, 12))
            stamp = f"20{pick(digits, 2, 2)}-{pick('01', 2, 2)}-{pick('012', 2, 2)}T{pick('01', 2, 2)}:{pick('012345', 2, 2)}:{pick('012345', 2, 2)}Z"
            hole = one("your-api-key-here", "xxxxxxxxxxxxxxxx", "$" + "{" + "SECRET_TOKEN}", "<password>", "process.env.API_KEY", "os.environ.get", "REDACTED_VALUE", "********", "changeit-later", "%(password)s", "config.password", "getpass.getpass")
            path = "/".join(one(ident(), say(), pick(digits, 2, 6)) for _ in range(rng.integers(2, 6))) + one("", ".png", ".html", ".js", "/")
            row = [
                (f"{head}{other()}{g}", pick(hexes, 32, 64)), (f"{prose(4)} {one('commit', 'merge', 'revert', 'tree')} ", pick(hexes, 40, 40)), (f"{head}{other()}{g}", uuid), (f"{head}{name()}{g}", hole), (f"{prose(4)} https://", f"{say()}.{say()}/{path}"),
                (f"{prose(4)} ", ident() + one("", pick(digits, 1, 4))), (f"{head}{other()}{g}", ident()), (f"{prose(5)} ", pick(digits, 12, 20)), (f"{head}{other()}{g}", one(stamp, f"{pick(digits, 1, 2)}.{pick(digits, 1, 2)}.{pick(digits, 1, 3)}-{say()}.{pick(digits, 1, 2)}")), (f"{prose(4)} {pick(digits, 3, 3)}-", "-".join(pick(digits, 3, 4) for _ in range(3))),
                (f"{prose(4)}: ", say() + say()), (f"{head}{other()}{g}", path), (f"{prose(3)} {pick(hexes, 32, 64)}  ", f"{ident()}-{pick(digits, 1, 2)}.{pick(digits, 1, 2)}"), (f"{prose(4)} src={one('', chr(34))}/", path),
            ][kind]
            out.append((*row, close(g) if kind in (0, 2, 3, 6, 8, 11) else one(" ", "\n", ". ") + prose(3)))
        label.append(float(k % 2))
    return out, np.array(label)


def _block_of(rows: list[tuple[str, str, str]]) -> tuple[Block, np.ndarray, np.ndarray]:
    """Findings as the texts of one block, and where their candidates stand."""
    parts = [tuple(x.encode() for x in r) for r in rows]
    b = next(text_blocks(pa.array([b"".join(p).decode() for p in parts]), 1 << 62)) if rows else Block(0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    first = b.offset[:-1] + np.array([len(p[0]) for p in parts], np.int64)
    return b, first, first + np.array([len(p[1]) for p in parts], np.int64)


def word_odds(rows: list[tuple[str, str, str]], y: np.ndarray) -> dict[str, float]:
    """Smoothed log-odds of a secret beside each word that stands before at least three training findings."""
    b, first, last = _block_of(rows)
    seen, bad = Counter(), Counter()
    for words, is_secret in zip(_neighbours(b, first, last)[0], y.tolist(), strict=True):
        for w in set(words):
            seen[w] += 1
            bad[w] += is_secret
    share = (y.sum() + 1) / (len(y) + 2)
    prior = np.log(share / (1 - share))
    return {w: float(np.log((bad[w] + 2 * share) / (n - bad[w] + 2 * (1 - share))) - prior) for w, n in seen.items() if n >= 3}


def train(labelled: DataFrame | None = None, max_train_rows: int = MAX_TRAIN_ROWS, vocabulary: str | None = None) -> Scanner:
    """``labelled``: before, candidate, after, is_secret. ``vocabulary``: a tokenizer file whose whole words are the dictionary. Log-odds are learned on one half and the forest on the other, so that it does not trust words beyond their worth."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    if labelled is None:
        rows, y = labelled_findings()
    else:
        got = labelled.filter("candidate is not null and candidate <> '' and is_secret is not null").orderBy(F.xxhash64("before", "candidate", "after"), "candidate").limit(max_train_rows).collect()
        rows, y = [(r["before"] or "", r["candidate"], r["after"] or "") for r in got], np.array([float(r["is_secret"]) for r in got])
    half = np.arange(len(rows)) % 4 < 2
    scanner = Scanner(dictionary(vocabulary), word_odds([r for r, h in zip(rows, half, strict=True) if h], y[half]), Forest())
    b, first, last = _block_of([r for r, h in zip(rows, half, strict=True) if not h])
    scanner.forest.fit(scanner.features(b, first, last), y[~half])
    return scanner


FINDING = "doc_id long, start long, length long, kind string, score double, is_secret boolean"


def findings(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate; start counts code points from the text's first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                doc, first, last, score, kinds = scanner.scan(b)
                points = np.zeros(len(b.data) + 1, np.int64)
                np.cumsum((b.data & 0xC0) != 0x80, out=points[1:])
                start = points[first] - points[b.offset[doc]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.docs).take(pa.array(doc)), pa.array(start), pa.array(last - first), pa.array(kinds, pa.string()), pa.array(score), pa.array(score >= threshold)], ["doc_id", "start", "length", "kind", "score", "is_secret"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scan, FINDING).withColumnRenamed("doc_id", id_col)


def redact(text: Column, scanner: Scanner, threshold: float = THRESHOLD) -> Column:
    """The text with each secret replaced by MASK; null stays null."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[str | None] = texts.to_pylist()
            for b in text_blocks(texts):
                doc, first, last, score, _ = scanner.scan(b)
                bad = np.flatnonzero(score >= threshold)
                for d in np.unique(doc[bad]).tolist():
                    raw, at, parts = b.data[b.offset[d] : b.offset[d + 1]].tobytes(), 0, []
                    for k in bad[doc[bad] == d].tolist():
                        s, e = int(first[k] - b.offset[d]), int(last[k] - b.offset[d])
                        parts += [raw[at:s], MASK.encode()]
                        at = e
                    out[b.first + d] = b"".join([*parts, raw[at:]]).decode()
            yield pa.array(out, pa.string())

    return clean(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), train())
