"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for urls under no rule.

The trees learn from a table of labelled urls, of which at most ``max_train_rows`` of smallest hash are read. Where the caller has none, ``labelled_urls`` writes a seeded set
after the shapes that public block lists and crawls are known for: wanted addresses of articles, shops, wikis, files and forums, and unwanted ones of keyword hosts, generated hosts, bare
numbers as hosts, redirectors with many parameters, deep or padded paths and throw-away suffixes. Rules are no labels: they say which parts of the web are wanted, not how an unwanted url looks. Features, none of them a word list:
lengths, depth, digit ratio, entropies, parameter counts, hyphens, labels of the host, escapes, how letters alternate, and the share of
blocked urls among training urls of the same suffix. They are sums over flat byte arrays, and urls that a rule has judged are not scored. Scoring is one pass without a shuffle.

A null url, or one without ``://``, has empty host and path, matches no rule and is judged by its features. Urls of any length are read whole. Repeated rows are judged one by one, null ids are
carried along, an empty table gives no rows. All columns of the input are kept; one named like the verdict column is refused, as is an output name that the caller has given already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.blocks import Block, text_blocks
from skerry.llm.trees import BoostedTrees

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_TRAIN_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)://([^/?#]*)([^?#]*)"
_BYTE = np.arange(256)
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
VOWEL = LETTER & np.isin(_BYTE | 32, np.frombuffer(b"aeiouy", np.uint8))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path begins the url's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _parts(b: Block) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """First and last byte of each url's host, path and query."""
    d, low, high = b.data, b.offset[:-1], b.offset[1:]

    def first(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = np.append(np.flatnonzero(mask), len(d))
        return np.minimum(at[np.searchsorted(at, start)], end)

    scheme = np.zeros(len(d), bool)
    if len(d) > 2:
        scheme[:-2] = (d[:-2] == 58) & (d[1:-1] == 47) & (d[2:] == 47)
    mark = first(scheme, low, high)
    host = np.minimum(np.where(mark < high, mark + 3, high), high)
    slash, query, hash_ = d == 47, d == 63, d == 35
    host_end = first(slash | query | hash_, host, high)
    path_end = first(query | hash_, host_end, high)
    asked = (path_end < high) & (np.append(d, 0)[np.minimum(path_end, len(d))] == 63)
    start = np.where(asked, path_end + 1, path_end)
    return {"url": (low, high), "host": (host, host_end), "path": (host_end, path_end), "query": (start, np.where(asked, first(hash_, start, high), start))}


def suffixes(b: Block) -> list[str]:
    """The last label of each host, lower-cased."""
    start, end = _parts(b)["host"]
    raw = b.data.tobytes()
    return [raw[s:e].rpartition(b".")[2].lower().decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def features(b: Block, shares: np.ndarray) -> np.ndarray:
    """A row for each url; ``shares``: the blocked share of its suffix."""
    d, parts, n = b.data, _parts(b), b.docs
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    inside = lambda s, part: s[parts[part][1]] - s[parts[part][0]]
    size = {k: e - s for k, (s, e) in parts.items()}

    def entropy(part: str) -> np.ndarray:
        s, m = parts[part][0], size[part]
        out, step = np.zeros(n), 4096
        for a in range(0, n, step):
            k = m[a : a + step]
            owner = np.repeat(np.arange(len(k)), k)
            at = np.repeat(s[a : a + step] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            p = np.bincount(owner * 256 + d[at], minlength=len(k) * 256).reshape(len(k), 256) / np.maximum(k, 1)[:, None]
            out[a : a + step] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        return out

    digits, hyphens, dots, slashes = (sums(x) for x in (DIGIT[d], d == 45, d == 46, d == 47))
    letters = LETTER[d]
    swap = np.concatenate(([False], letters[1:] & letters[:-1] & (VOWEL[d][1:] != VOWEL[d][:-1]))) if len(d) else np.zeros(0, bool)
    other = sums((d == 37) | (d == 64) | (d == 126) | (d >= 128))
    host_letters = inside(sums(letters), "host")
    columns = [size["url"], size["host"], size["path"], size["query"], inside(slashes, "path"), inside(dots, "host"), inside(digits, "url") / np.maximum(size["url"], 1), inside(digits, "host") / np.maximum(size["host"], 1), inside(hyphens, "host"), inside(hyphens, "path"), inside(sums(d == 61), "query"), inside(other, "url"), entropy("host"), entropy("path"), inside(sums(swap), "host") / np.maximum(host_letters, 1), host_letters == 0, shares]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def labelled_urls(n: int = 6000, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """n urls, of which a third are to be blocked. Words are made of random syllables, so no word tells the classes apart."""
    rng = np.random.default_rng(seed)
    one = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda k=3: "".join(one(*"bcdfghklmnprstvwz") + one(*"aeiou") + one("", "", *"nrstl") for _ in range(rng.integers(1, k + 1)))
    noise = lambda low, high: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), rng.integers(low, high)))
    number = lambda k: str(int(rng.integers(10 ** rng.integers(1, k + 1))))
    slug = lambda low, high: "-".join(word() for _ in range(rng.integers(low, high)))
    urls, blocked = [], []
    for k in range(n):
        bad = k % 3 == 0
        scheme = one("https://", "https://", "http://")
        if bad:
            suffix = one("com", "com", "net", "org", "info", "biz", "xyz", "top", "click", "icu", "site", "online")
            kind = int(rng.integers(0, 6))
            host = [slug(2, 5), slug(2, 4) + number(4), noise(10, 28), ".".join(str(int(x)) for x in rng.integers(1, 255, 4)), one("go", "r", "track", "ads", "click") + number(3) + "." + word(), ".".join(noise(4, 12) for _ in range(rng.integers(2, 5))) + "." + word()][kind]
            host = host if kind == 3 else one("", "", "www.", "m.") + host + "." + suffix
            path = one("", "/", "/" + slug(2, 9), "/" + noise(8, 40), "/" + "/".join(noise(2, 10) for _ in range(rng.integers(3, 9))), "/" + slug(1, 3) + "/" + number(6))
            query = one("", "", "?" + "&".join(f"{noise(1, 5)}={noise(4, 24)}" for _ in range(rng.integers(1, 10))), "?" + one("aff", "ref", "cid", "url") + "=" + noise(8, 40))
        else:
            suffix = one("com", "com", "com", "org", "org", "net", "net", "edu", "de", "fr", "co.uk", "io", "info")
            host = one("www.", "www.", "", "", "", f"{word(2)}.", "blog.", "en.", "docs.", "shop.", "forum.", "m.") + one(word(4), word(4), word(4), word(3) + "." + word(3), word(2) + "-" + word(2) if rng.random() < 0.3 else word(4)) + "." + suffix
            path = one("", "/", "/" + word(), f"/{one('20', '19')}{number(2)}/{number(2)}/{slug(3, 8)}", f"/{word()}/{word()}/{number(5)}", f"/wiki/{word().title()}_{word()}", f"/~{word(2)}/{word()}.html", f"/{word()}/index.php", f"/files/{word()}-{number(2)}.{number(1)}.tar.gz", f"/{slug(2, 6)}-{number(6)}.html", f"/{one('en', 'de', 'fr', 'es', 'it')}/{slug(1, 4)}", f"/{word()}/{slug(2, 7)}/")
            query = one("", "", "", "", f"?{one('id', 'p', 'page', 'lang', 'v')}={number(5)}", f"?q={word()}+{word()}", f"?{word(2)}={word(2)}&{word(2)}={number(3)}", f"#{word()}", f"?utm_source={word()}&utm_medium={word()}")
        urls.append(scheme + host + path + query)
        blocked.append(float(bad))
    return urls, np.array(blocked)


class UrlModel:
    """Suffix shares and boosted trees."""

    def __init__(self, urls: list[str | None], blocked: np.ndarray):
        self.share = float((blocked.sum() + 1) / (len(blocked) + 2))
        if not urls:
            self.shares, self.trees = {}, BoostedTrees().fit(np.zeros((0, 17)), blocked)
            return
        b = next(text_blocks(pa.array(urls, pa.string()), 1 << 62)) if len(urls) <= 65536 else None
        if b is None:
            raise ValueError("at most 65,536 urls are learned from")
        names, at = np.unique(suffixes(b), return_inverse=True)
        seen, bad = np.bincount(at), np.bincount(at, blocked)
        self.shares = dict(zip(names.tolist(), ((bad + 5 * self.share) / (seen + 5)).tolist(), strict=True))
        self.trees = BoostedTrees().fit(self.matrix(b), blocked)

    def matrix(self, b: Block) -> np.ndarray:
        return features(b, np.array([self.shares.get(s, self.share) for s in suffixes(b)]))

    def predict(self, urls: pa.Array) -> np.ndarray:
        parts = [self.trees.predict(self.matrix(b)) for b in text_blocks(urls)]
        return np.concatenate(parts) if parts else np.zeros(0)


def train(labelled: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> UrlModel:
    """``labelled``: url, blocked (0/1). Reads at most ``max_train_rows`` different urls to the driver."""
    known = labelled.filter("blocked is not null and url is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    rows = known.orderBy(F.xxhash64("url"), "url").limit(min(max_train_rows, 65_536)).collect()
    return UrlModel([r["url"] for r in rows], np.array([float(r["blocked"]) for r in rows]))


def block_score(url: Column, wanted: Column, model: UrlModel) -> Column:
    """The trees' probability where ``wanted``, else null."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, flags in batches:
            flags = flags.to_numpy(zero_copy_only=False)
            out = np.zeros(len(urls))
            out[flags] = model.predict(urls.filter(pa.array(flags)))
            yield pa.array(out, pa.float64(), mask=~flags)

    return score(url, wanted)


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5, name: str = "url_verdict") -> DataFrame:
    """The pages with one struct column ``name``: host, path, rule, block_score (null under a rule), verdict."""
    if name.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"there is a column {name} already")
    url, v = F.col(url_col), F.col(name)
    parts = pages.withColumn(name, F.struct(host_of(url).alias("host"), path_of(url).alias("path")))
    said = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else None
    model = train(labelled) if labelled is not None else UrlModel(*labelled_urls())
    ruled = parts.withColumn(name, v.withField("rule", rule_of(v["host"], v["path"], rules)))
    scored = ruled.withColumn(name, v.withField("block_score", block_score(url, v["rule"].isNull(), model)))
    judged = F.when(v["block_score"] >= threshold, "block").otherwise("allow")
    return scored.withColumn(name, v.withField("verdict", F.coalesce(said[v["rule"]], judged) if rules else judged))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.verdict", "url_verdict.block_score")


_HOST = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
#: What SQL can express of the query: host, path, rule, and the verdict under a rule.
RULES_SQL = f"""
SELECT *, {"CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES) + " END"} AS ruled
FROM (SELECT *, CASE {_RULE} END AS rule FROM (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages))
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's own columns as far as SQL can express them."""
    return op1_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))
