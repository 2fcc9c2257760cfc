"""Every operator against brute force, an exact round trip or held-out accuracy, and over odd rows."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skerry.llm import op1_urls, op2_toxicity, op3_hyperminhash, op4_lm, op5_topk, op7_chat, op8_packing, op9_mixing, op10_quality, queries
from skerry.llm.blocks import text_blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, verdict string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t", "en", None, 3, ""), (None, "one two three four five six seven", "en", "a", 30, "x"), (None, None, None, None, None, None), (4, "Same Words here in this very text", "de", "b", 33, "x"), (4, "Same Words here in this very text", "de", "b", 33, "x"), (5, "same words HERE in this very text", "fr", "b", 33, "x"), (6, LONG, "en", "a", len(LONG), "x"), (7, "ab", "en", "a", 2, "x"), (8, "AB", "en", "a", 2, "x"), (9, "x y éè #$% <s>", "zz", "q", 9, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE[name])


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n, n < 50 or 100 * len(inside) > 50 * n)


def test_quality_base(spark, sf, odd):
    got = {r["doc_id"]: r for r in op10_quality.op10_quality(spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        r = got[i]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_words"], r["base_failed"]) == brute_quality(t)
    for r in odd.select("*", op10_quality.quality_verdict(F.col("text")).alias("verdict2")).collect():
        v = r["verdict2"]
        assert (v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"], v["n_words"], v["base_failed"]) == brute_quality(r["text"])


def test_quality_rejects_repeated_lines_only(spark):
    plain = " ".join(f"word{i}" for i in range(80))
    v = op10_quality.judge_block(next(text_blocks(pa.array([plain, "\n".join([" ".join(f"a{i}" for i in range(30))] * 3 + [plain[:60]])]))))
    assert v["kept"].tolist() == [True, False]


def test_quality_rejects_repeated_ngrams_that_pass_the_base_rule():
    """One line each: a passage of 30 words twice, and one of 6, among 140 others."""
    others, passage = [f"word{i}" for i in range(140)], [f"again{i}" for i in range(30)]
    v = op10_quality.judge_block(next(text_blocks(pa.array([" ".join([*p, *others, *p]) for p in (passage, passage[:6])]))))
    assert v["base_failed"].tolist() == [False, False] and v["line_coverage"].tolist() == [0, 0]
    assert (v["coverage_10"] > 0.1).tolist() == [True, False] and v["kept"].tolist() == [False, True]


def test_near_duplicates_of_odd_rows(odd, empty):
    got = op3_hyperminhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 7, 7, 9]
    assert by[2]["n_shingles"] == 0 and by[7]["n_shingles"] == 1 and by[4]["n_shingles"] == 3
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert op3_hyperminhash.near_duplicates(empty).isEmpty()


def test_near_duplicates_chain_and_hot_bucket(spark, monkeypatch):
    """A chain whose ends are not similar, and near copies dealt over many cells, against brute force."""
    monkeypatch.setattr(op3_hyperminhash, "CELL", 8)
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        for k in rng.choice(120, d % 4, replace=False):
            w[k] = f"r{d}-{k}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join([f"c{i}" for i in range(d * 6, 200 + d * 6)])) for d in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if up[b] < up[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    up[a], changed = up[b], True
    assert got == up


def brute_components(rows, percent):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    up, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if up[b] < up[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    up[a], changed = up[b], True
    return up


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_of_small_sets(spark, percent):
    """Texts of few words, each with the same text and one word more at an end, and a chain through them, against brute force."""
    rows = []
    for n in range(7, 13):
        w = [f"s{n}x{i}" for i in range(n)]
        rows += [(n * 10, " ".join(w)), (n * 10 + 1, " ".join([*w, "after"])), (n * 10 + 2, " ".join(["before", *w, "after"])), (n * 10 + 3, " ".join(w[1:]))]
    got = {r["doc_id"]: r["component_id"] for r in op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    want = brute_components(rows, percent)
    assert want[101] == 100 and (want[81] == 80) == (percent == 80)
    assert got == want


@pytest.mark.parametrize("percent", [50, 70, 95, 100])
def test_near_duplicates_at_other_percentages(spark, percent):
    """Texts that share between half and all of their words, against brute force."""
    rng = np.random.default_rng(percent)
    rows = []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(80)]
        rows += [(g * 100 + d, " ".join([*w[: 80 - 3 * d], *(f"x{g}-{d}-{k}" for k in range(3 * d))])) for d in rng.permutation(14).tolist()]
    got = {r["doc_id"]: r["component_id"] for r in op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute_components(rows, percent)
    with pytest.raises(ValueError):
        op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=5)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    """An id's rows are one component, and each of its texts is compared."""
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(5, a), (5, b), (9, f"{b} more"), (3, f"first {a}"), (8, "something else altogether that stands on its own")]
    got = collections.defaultdict(set)
    for r in op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got == {5: {3}, 9: {3}, 3: {3}, 8: {8}}


def test_near_duplicates_of_one_bucket_with_a_large_component(spark, monkeypatch):
    """Cells hold few classes; the largest component is compared with what is outside it only, and all links are found."""
    monkeypatch.setattr(op3_hyperminhash, "CELL", 5)
    base = [f"b{i}" for i in range(60)]
    rows = [(d, " ".join([*base, f"end{d}"])) for d in range(30)] + [(100 + d, " ".join([*base[:50], *(f"o{k}" for k in range(9)), f"end{d}"])) for d in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in op3_hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 85) and set(got.values()) == {0, 100}


def test_toxicity_on_held_out_misspellings(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 8)))
    rows = [(i, " ".join([word() for _ in range(30)] + (["zkrotten" + word()[:2]] * 2 if i % 3 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(450)] + [(None, 1), (5, None)], "id long, label int")
    model, share = op2_toxicity.train(docs, labels, max_train_rows=400)
    got = docs.filter("id >= 450").select("id", op2_toxicity.toxicity_score(F.col("text"), model, share).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.3) == (r["id"] % 3 == 0) for r in got]) > 0.95


def test_toxicity_without_labels(spark, odd):
    model, share = op2_toxicity.train(odd.select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([], "id long, label int"))
    assert all(0 <= r[0] <= 1 for r in odd.select(op2_toxicity.toxicity_score(F.col("text"), model, share)).collect())


def test_lm_counts_and_normalisation(spark, sf):
    docs = texts(spark, sf)
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = op4_lm.op4_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, r["doc_id"] not in set(train))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_score_against_brute_force(spark):
    """A vocabulary small enough to add up: every context's probabilities, of all known words and one unknown, sum to 1, and a text's score is the sum of its tokens'."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(1, 5)))
    rows = [(i, " ".join(word() for _ in range(12)), i % 5 == 0) for i in range(60)] + [(60, "", False), (61, None, True), (62, "Unseen-Word here", True)]
    corpus = op4_lm.Corpus(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    vocabulary = corpus.vocabulary(frequent=40)
    model = corpus.fit(vocabulary)
    assert 0 < len(vocabulary.words) <= 40
    split = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t, _ in rows}
    count = collections.Counter(w for i, _, h in rows if not h for w in split[i])
    whole = sum(count.values()) + len(count) + 1

    def rows_of(w):
        if w is None:
            return model.own(np.array([op4_lm.END])), np.zeros(1, np.uint16)
        b = next(text_blocks(pa.array([w])))
        return model.own(b.words()), op4_lm.forms(b)

    def factor(w, one, two):
        context = [int(model.rows(*rows_of(x))[2][0]) for x in (one, two)]
        q = sum(model.parts["R"][c] @ model.parts[k] for c, k in zip(context, ("C1", "C2"), strict=True))
        if w not in count:
            return 1 / whole
        a, z, _ = (int(x[0]) for x in model.rows(*rows_of(w)))
        return (count[w] + 1) / whole * math.exp(sum(float(q @ model.parts["R"][r] + model.parts["b"][r]) for r in (a, z)))

    got = {r["doc_id"]: r for r in corpus.score(model).collect()}
    for i in (0, 1, 2, 60, 61, 62):
        score, one, two = 0.0, None, None
        for w in split[i]:
            total = 1 / whole + sum(factor(x, one, two) for x in count)
            score += math.log10(factor(w, one, two) / total)
            one, two = w, one
        assert math.isclose(got[i]["score"], score, rel_tol=1e-4), i
    assert len({r["score"] for r in got.values()}) > 50


def test_lm_of_many_equal_rows(spark):
    """Equal rows are dealt over chunks of bounded size, and each gets the same score."""
    docs = spark.createDataFrame([(None, "the same words again", None)] * 3000 + [(1, "other words", False)], "doc_id long, text string, held_out boolean").coalesce(1)
    corpus = op4_lm.Corpus(docs, chunk_bytes=4000)
    assert corpus.chunks.agg(F.max(F.size("ids"))).first()[0] <= 200 and corpus.chunks.select("chunk").distinct().count() == corpus.chunks.count()
    out = corpus.score(corpus.fit(corpus.vocabulary())).collect()
    assert len(out) == 3001 and len({round(r["score"], 9) for r in out if r["doc_id"] is None}) == 1


def test_lm_holds_a_few_megabytes_at_a_time(spark, monkeypatch, tmp_path):
    """One task's share of 24 MB goes to Python in batches of a few MB, in each stage; the session's settings stay as they were."""
    log = str(tmp_path)

    def watched(make, name):
        def wrapped(*args):
            inner = make(*args)

            def run(batches):
                def seen():
                    for batch in batches:
                        with open(f"{log}/{name}", "a") as f:
                            f.write(f"{batch.nbytes}\n")
                        yield batch

                return inner(seen())

            return run

        return wrapped

    for name in ("_chunks", "_pass", "_placed"):
        monkeypatch.setattr(op4_lm, name, watched(getattr(op4_lm, name), name))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(0, 120, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(md5(string(id)), ' '), 6250)").alias("text"), (F.col("id") % 5 == 0).alias("held_out"))
    corpus = op4_lm.Corpus(docs, chunk_bytes=3 << 20)
    out = corpus.score(corpus.fit(corpus.vocabulary())).collect()
    assert len(out) == 120 and {r["n_tokens"] for r in out} == {6251}
    for name in ("_chunks", "_pass", "_placed"):
        assert max(map(int, (tmp_path / name).read_text().split())) < 8 << 20, name
    assert corpus.chunks.count() >= 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_lm_scores_many_contexts_in_bounded_memory():
    """What scoring holds besides its result is a few numbers a token, not a vector for each different context."""
    rng, n, tokens = np.random.default_rng(2), 3000, 400_000
    words = np.sort(rng.integers(1, 2**63, n, dtype=np.uint64))
    vocabulary = op4_lm.Vocabulary(10 * n, n, words, np.full(n, 10), 5, np.ones((op4_lm.BEGINNINGS, op4_lm.ENDINGS)))
    model = op4_lm.LogBilinear(vocabulary)
    one, two = (rng.integers(0, n, tokens).astype(np.int32) for _ in range(2))
    a, z = one[::-1].copy(), np.full(tokens, model.zero, np.int32)
    log_u = np.full(tokens, -5.0)
    tracemalloc.start()
    got = model.log_prob(log_u, a, z, one, two)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 * tokens
    for i in range(0, tokens, 80_000):
        q = model.parts["R"][one[i : i + 1]] @ model.parts["C1"] + model.parts["R"][two[i : i + 1]] @ model.parts["C2"]
        want = log_u[i] - model.log_z(q)[0] + model.log_factor(q, a[i : i + 1], z[i : i + 1])[0]
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_lm_of_odd_rows(odd, empty):
    with_flag = lambda df: df.withColumn("held_out", F.lit(False))
    assert op4_lm.score_texts(with_flag(odd)).count() == len(ODD)
    assert op4_lm.score_texts(with_flag(empty)).isEmpty()


def test_topk_with_ties_and_bad_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(0, 40)] + [(100, None), (101, [float("nan"), 1.0]), (102, [None, 1.0]), (103, [float("inf"), 0.0]), (0, [0.0, 1.0]), (None, [1.0, 1.0]), (104, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", op5_topk.quantise(F.col("e")).alias("v"))
    got = op5_topk.top_k(df, df.filter("id in (0, 104)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    assert op5_topk.top_k(df.filter("id < 0"), df.filter("id < 0")).isEmpty()


def test_the_bound_stops_where_components_are_uneven():
    """On vectors with a few large components most rows are never met; the result is that of brute force either way."""
    rng = np.random.default_rng(2)
    for skew, share in ((4.0, 0.5), (0.0, 1.0)):
        x = np.floor(256 * rng.normal(size=(3000, 32)) * np.exp(-skew * np.arange(32) / 8))
        order = np.argsort(x, axis=0, kind="stable").T
        met = 0
        for i in range(0, 3000, 300):
            score, best, n = op5_topk.threshold_top_k(x[i], i, x, np.arange(3000), order, 5)
            full = x @ x[i]
            full[i] = -np.inf
            assert best.tolist() == np.lexsort((np.arange(3000), -full))[:5].tolist() and score.tolist() == full[best].tolist()
            met += n / 30_000
        assert met <= share


def test_url_rules(spark):
    rows = [(1, "http://A.Example.com/en/1?x"), (2, "https://www.example.com/en/2"), (3, "ftp://x.net/es/#a"), (4, None), (5, "no scheme"), (6, "http://com"), (7, "http://example.com/fr/"), (8, "https://buy-now-cheap-stuff.example.org/fr/3"), (9, "https://blog.motion.example.org/en/7")]
    got = {r["page_id"]: r["url_verdict"] for r in op1_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(1, 10)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, "com/", None, None]
    assert (got[1]["host"], got[1]["path"], got[4]["host"], got[6]["path"]) == ("a.example.com", "/en/1", "", "")
    assert [got[i]["verdict"] for i in (1, 2, 3, 7, 8, 9)] == ["block", "allow", "block", "allow", "block", "allow"]


def test_chat_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    hot = "shared [INST] first \\l turn"
    rows = [(c, 0, "system", hot) for c in range(50)] + [(c, 1, "user", f"</s><s>[INST]{c % 7}<|endoftext|>") for c in range(50)] + [(c, 2, "assistant", f"réponse {c % 3}\\\\") for c in range(50)] + [(60, None, None, None), (60, 1, "assistant", ""), (None, 0, "user", "x"), (61, 0, "assistant", "a"), (61, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = op7_chat.format_trees(df, path, max_tokens=300)
    got = {r["conv_id"]: r for r in op7_chat.read_back(trees, path).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = op7_chat.format_trees(df, path).selectExpr("size(nodes) n", "size(tokens) t", "size(positions) p").collect()
    assert sum(r["n"] for r in one) < len(rows) and all(r["t"] == r["p"] for r in one)
    assert op7_chat.read_back(op7_chat.format_trees(df.filter("conv_id < 0"), path), path).isEmpty()


def check_packing(got, want):
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    return len(full), sum(r["length"] for r in got)


def brute_pieces(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, x in docs.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            out[i, p // 4096] = (p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes()))
    return out


def test_packing(spark, sf, odd, empty):
    docs = texts(spark, sf)
    used, total = check_packing(op8_packing.op8_packing(spark, sf).collect(), brute_pieces(docs))
    assert used <= math.ceil(total / 4096) * 1.02 + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    some = {r[0]: r[1] for r in ODD if r[0] is not None}
    check_packing(op8_packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), path).collect(), brute_pieces(some))
    assert op8_packing.pack(odd, path).select("doc_id").count() >= len(ODD)
    assert op8_packing.pack(empty, path).isEmpty()


def test_packing_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows each: gaps are carried over borders until every piece has its place, nearly as tight as in one range."""
    monkeypatch.setattr(op8_packing, "ROWS_PER_RANGE", 40)
    rng = np.random.default_rng(1)
    docs = {i: " ".join(f"t{k % 50}" for k in range(int(rng.choice([3, 30, 300, 900, 1500])))) for i in range(400)}
    pieces, room = brute_pieces(docs), []
    for n in sorted((x[1] for x in pieces.values()), reverse=True):  # best-fit decreasing
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 4096) - n)
    used, _ = check_packing(op8_packing.pack(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect(), pieces)
    assert used <= len(room) * 1.03 + 1


def test_sweep_takes_the_longest_that_fits_and_carries_the_rest():
    kind, size = np.array([0, 0, 0, 1, 0, 1, 1]), np.array([5, 7, 7, 7, 9, 20, 20])
    kind, left, reach, sequence, offset = op8_packing.sweep(kind, size, size.copy(), np.arange(100, 107), 100)
    assert kind.tolist() == [2, 2, 2, 1, 2, 1, 1] and left[[3, 5, 6]].tolist() == [0, 4, 15]
    assert sequence[[0, 1, 2, 4]].tolist() == [106, 105, 103, 105] and offset[[0, 1, 2, 4]].tolist() == [80, 89, 93, 80]
    assert reach[[3, 5, 6]].tolist() == [0, 4, 4]  # the range begins at 5


def test_mixing_meets_targets(spark, odd, empty):
    cells = [(s, x, t, 100.0 * (1 + i)) for i, (s, x, t) in enumerate((s, x, t) for s in ("src0", "*") for x in ("en", "de") for t in ("prose", "technical"))]
    fitted = op9_mixing.rake(cells, op9_mixing.Targets())
    total = sum(c[3] for c in cells)
    assert math.isclose(sum(c[3] / total * fitted[c[:3]][0] for c in cells if c[0] == "src0"), 0.25, rel_tol=1e-3)
    assert math.isclose(sum(c[3] * fitted[c[:3]][1] for c in cells) / total, 0.8, rel_tol=1e-6)
    kinds = [[(np.array([c[0] == s for c in cells]), g) for s, g in (("src0", 0.25), ("*", 0.75))]]
    assert op9_mixing.residual(np.array([c[3] / total * fitted[c[:3]][0] for c in cells]), kinds) < 1e-3
    with pytest.raises(ValueError):
        op9_mixing.mix_sources(odd.withColumn("mix", F.lit(1)))
    given = op9_mixing.mix_sources(odd.withColumn("t", F.lit("tabular")), topic_col="t")
    assert {r[0] for r in given.select("mix.topic").distinct().collect()} == {"tabular"}
    assert op9_mixing.mix_sources(odd).count() == len(ODD) and op9_mixing.mix_sources(empty).isEmpty()


def test_pipeline_stages(spark, odd, empty, tmp_path):
    docs = odd.union(spark.createDataFrame([(20 + k, f"{' '.join(f'w{i}' for i in range(60))} password=b7db7aa4a5fcc7830{k // 2}", "en", "src0", 1, "x") for k in range(4)], DOCS))
    for rows in (docs, empty):
        now = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{rows is docs}{k}")
            stage(spark, now, "").write.parquet(out)
            now = spark.read.parquet(out)
            if k < 4:
                assert now.columns == corpus_pipeline.COLUMNS
            if rows is docs and k == 1:
                assert {r["doc_id"] for r in now.collect()} == {6, 20}
            if rows is docs and k == 2:
                assert "[SECRET]" in now.filter("doc_id = 20").first()["text"]
    assert now.isEmpty()


def test_pipeline_links_near_copies_from_80_percent_on(spark):
    """96 shingles each; one changed word in the middle takes 5 of them, so two leave 86 of 106 in common (0.81) and three 81 of 111 (0.73)."""
    base = [f"w{i}" for i in range(100)]
    change = lambda *at: " ".join("other" + w if i in at else w for i, w in enumerate(base))
    docs = spark.createDataFrame([(1, change(), "en", "a", 1, ""), (2, change(30, 60), "en", "a", 1, ""), (3, change(20, 50, 80), "en", "a", 1, "")], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}
    assert {r["component_id"] for r in op3_hyperminhash.near_duplicates(docs).collect()} == {1, 2, 3}
