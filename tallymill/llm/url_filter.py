"""URL filter: allow/block rules first, then host word segmentation and naive Bayes.

Hosts are split into words by a unigram Viterbi search. Every word of all page texts counts: the distinct names in
hosts and paths are dealt out, and their substrings joined with the whole table of word counts. The words of host
and path are scored by a multinomial naive Bayes model, which blocks if they are EVIDENCE times as likely under it.

The model learns from the URLs that a rule decides, or from labelled URLs that the caller has. The rule's verdict is the
label; the part of host and path that the rule itself names is left out, so the model does not repeat the rule. Every occurrence of a
token in the distinct URLs of a label counts, and the prior is the labels' share of these URLs. Hosts whose crc32 modulo 5 is
0 are held out of training: what the method says of their rule pages measures it.

Parts of any length are split: their pieces of up to LONGEST letters are looked up STRETCH starting places at a time, under the part's number.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed (score 0);
rules of equal length are told apart by order of the list; rows that repeat a page_id are judged each; URLs and page texts
of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import collections
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_join, table, tidy

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: How many times likelier the tokens must be under block than under allow.
EVIDENCE = 4.0
#: Common host words that page texts may lack (segmentation only; they decide nothing).
HOST_WORDS = ("www", "blog", "shop", "news", "mail", "farm", "wiki", "docs", "info", "site", "web", "com", "net", "org", "example")
#: Naive Bayes buckets, and the longest piece that is tried as a word: a whole label of a host.
BUCKETS, LONGEST = 1 << 15, 63
#: Starting places of a part whose pieces are sent together, and pieces in an Arrow batch.
STRETCH, PIECES = 500, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Lexicon:
    """Unigram log probabilities; unknown words cost more the longer they are."""

    logp: dict[str, float]
    unknown: float

    @classmethod
    def of(cls, counts: dict[str, int]) -> Lexicon:
        total = sum(counts.values()) or 1
        return cls({w: math.log(n / total) for w, n in counts.items()}, math.log(0.1 / total))

    def segment(self, text: str) -> list[str]:
        """The likeliest split of ``text`` into words."""
        best, back = [0.0], [0]
        for i in range(1, len(text) + 1):
            top, at = -math.inf, i - 1
            for j in range(max(0, i - LONGEST), i):
                w = text[j:i]
                s = best[j] + (self.logp[w] if w in self.logp else self.unknown - 2.5 * (i - j - 1))
                if s > top:
                    top, at = s, j
            best.append(top)
            back.append(at)
        words, i = [], len(text)
        while i:
            words.append(text[back[i] : i])
            i = back[i]
        return words[::-1]


def host_parts(host: str) -> list[str]:
    """Runs of letters in the labels of a host; "#" stands for a run of digits."""
    return ["#" if part[0].isdigit() else part for part in re.findall(r"[a-z]+|[0-9]+", host)]


def path_parts(path: str) -> list[str]:
    """Runs of letters; "#" stands for a run of digits."""
    return ["#" if part[0].isdigit() else part for part in re.findall(r"[^\W\d_]+|\d+", path.lower())]


def tokens(host: str, path: str, words: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Those of host and path; words: the split of each part."""
    return [w for x in host_parts(host) for w in words[x]], [f"/{w}" for x in path_parts(path) for w in words[x]]


def beside(host: str, path: str, rule: str) -> tuple[str, str]:
    """What is left of host and path without what the rule names."""
    end, slash, start = rule.partition("/")
    return host[: len(host) - len(end)], path[len(slash + start) :]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


@dataclass(frozen=True)
class NaiveBayes:
    """Log-odds (block against allow) by token bucket."""

    prior: float
    odds: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, urls: tuple[int, int] = (0, 0), alpha: float = 1.0) -> NaiveBayes:
        """counts: [2, BUCKETS] token occurrences of allow, block; urls: how many URLs of either were counted."""
        used = max(1, int((counts.sum(0) > 0).sum()))
        logp = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * used)
        return cls(math.log((urls[1] + alpha) / (urls[0] + alpha)), (logp[1] - logp[0]) * (counts.sum(0) > 0))

    def score(self, tokens: list[str]) -> float:
        return self.prior + sum(self.odds[bucket(t)] for t in tokens)


def word_counts(texts: DataFrame, column: str = "html") -> DataFrame:
    """(w, n): every word of all page texts (tags removed)."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    return materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "word-counts")


def split_parts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, words): the likeliest split of every distinct part, by all word counts."""
    listed = sorted(HOST_WORDS)
    total = counts.agg(F.sum("n")).first()[0] or 0
    base, has = max(10, total // 2000), {r.w: r.n for r in counts.filter(F.col("w").isin(listed)).collect()}
    least = {w: max(has.get(w, 0), base) for w in listed}
    total += sum(least.values()) - sum(has.values())
    unknown = math.log(0.1 / total)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(part's number, piece), each piece once for a stretch of its part."""
        numbers, found = [], []
        for pdf in batches:
            for number, x in zip(pdf["number"], pdf["part"], strict=True):
                for a in range(0, len(x), STRETCH):
                    new = {x[i:j] for i in range(a, min(len(x), a + STRETCH)) for j in range(i + 1, min(len(x), i + LONGEST) + 1)}
                    numbers += [number] * len(new)
                    found += new
                    if len(found) >= PIECES:
                        yield pd.DataFrame({"number": numbers, "w": found})
                        numbers, found = [], []
        yield pd.DataFrame({"number": pd.Series(numbers, dtype="int64"), "w": pd.Series(found, dtype="str")})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = []
            for x, hits in zip(pdf["part"], pdf["hits"], strict=True):
                n = {w: k for w, k in least.items() if w in x} | {h["w"]: least.get(h["w"], h["n"]) for h in (hits if hits is not None else ())}
                words.append(["#"] if x == "#" else Lexicon({w: math.log(k / total) for w, k in n.items()}, unknown).segment(x))
            yield pd.DataFrame({"part": pdf["part"], "words": words})

    distinct = materialize(parts.select("part").distinct().withColumn("number", F.monotonically_increasing_id()), "parts")
    cut = materialize(distinct.select("number", "part").mapInPandas(pieces, "number long, w string"), "pieces")
    # counts has a row for each word: pieces that many parts hold (single letters) are dealt out
    often = materialize(hot_keys(cut.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w"), "hot-pieces")
    found = salted_join(cut, counts, ["w"], often, ["number"])
    hits = found.groupBy("number").agg(F.collect_set(F.struct("w", "n")).alias("hits"))
    return materialize(distinct.join(hits, "number", "left").select("part", "hits").mapInPandas(split, "part string, words array<string>"), "split-parts")


def split_urls(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, rule, label, held_out, words) of every distinct URL: words are (part, words) of its parts."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = []
            for h, p, r in zip(pdf["host"], pdf["path"], pdf["rule"], strict=True):
                h2, p2 = beside(h, p, r or "")
                each.append(sorted({*host_parts(h), *path_parts(p), *host_parts(h2), *path_parts(p2)}) or [""])
            yield pdf.assign(part=each).explode("part")

    columns = "host string, path string, rule string, label string, held_out boolean"
    urls = parsed.select("host", "path", "rule", "label", (F.crc32(F.col("host")) % 5 == 0).alias("held_out")).distinct()
    some = materialize(urls.mapInPandas(parts, f"{columns}, part string"), "url-parts")
    # nearly every URL holds the parts "com", "www" and "#"
    often = materialize(hot_keys(some.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part"), "hot-parts")
    whole = salted_join(some, split_parts(some, counts), ["part"], often, ["host", "path"])
    return materialize(whole.groupBy("host", "path", "rule", "label", "held_out").agg(F.collect_list(F.struct("part", "words")).alias("words")), "split-urls")


def train(urls: DataFrame) -> NaiveBayes:
    """urls: as of ``split_urls``. Token occurrences over all labelled URLs that are not held out; at most 2 x BUCKETS sums reach the driver."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = collections.Counter()
            for h, p, r, label, words in zip(pdf["host"], pdf["path"], pdf["rule"], pdf["label"], pdf["words"], strict=True):
                split, block = {x["part"]: list(x["words"]) for x in words}, int(label == "block")
                sums.update((block, bucket(t)) for t in sum(tokens(*beside(h, p, r or ""), split), []))
                sums[block, -1] += 1
            yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["label", "bucket", "n"])

    known = urls.filter("label IS NOT NULL AND NOT held_out")
    counts = np.zeros((2, BUCKETS + 1))  # the last column counts URLs
    for r in known.mapInPandas(seen, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.bucket] = r.n
    return NaiveBayes.of(counts[:, :-1], tuple(counts[:, -1]))


@tidy("urls")
def url_filter(pages: DataFrame, rules=RULES, model: NaiveBayes | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, method (the verdict of the method alone), score (log-odds of block), words (the segmented host) and held_out of
    every page. labelled: (url, verdict) rows to learn from instead of the rules."""
    host, path = split_url(F.col("url"))
    named = lambda df, *more: df.select(*more, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = named(pages, "page_id").select("*", rule.alias("rule"), verdict.alias("rule_verdict"))
    counts = word_counts(pages)
    urls = split_urls(parsed.withColumn("label", F.col("rule_verdict")), counts)
    if model is None:
        examples = urls if labelled is None else split_urls(named(labelled, "verdict").select("*", F.lit(None).cast("string").alias("rule"), F.col("verdict").alias("label")), counts)
        model = train(examples)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [tokens(h, p, {x["part"]: list(x["words"]) for x in words}) for h, p, words in zip(pdf["host"], pdf["path"], pdf["words"], strict=True)]
            scores = [float(model.score([*w, *rest])) if w else 0.0 for w, rest in split]
            yield pd.DataFrame({"host": pdf["host"], "path": pdf["path"], "held_out": pdf["held_out"], "score": scores, "words": [" ".join(w) for w, _ in split]})

    judged = materialize(urls.select("host", "path", "held_out", "words").mapInPandas(judge, "host string, path string, held_out boolean, score double, words string"), "judged")
    often = materialize(hot_keys(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "host", "path"), "hot-urls")
    whole = salted_join(parsed, judged, ["host", "path"], often, ["page_id"])
    method = F.when(F.col("score") > math.log(EVIDENCE), "block").otherwise("allow")
    return whole.withColumn("method", method).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "method").alias("verdict"), "method", "score", "words", "held_out")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
