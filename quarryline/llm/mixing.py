"""Sources mixed to target shares of all tokens.

Sizes are tokens of a public tokenizer. A source may give each document at most `max_repeats` times, so
its budget is capped. Either the mixture is as large as it can be with every share met (`SHARES`), or a size
is given: then the budgets of sources that reach their cap end there and those of the others are raised in
proportion until they fill the total. Of a source's budget, complete epochs come first; the rest is a weighted
sample without replacement: each document draws an exponential key divided by its quality weight, and the
documents with the smallest keys are taken until their tokens reach the budget. The running sums are two-level:
bins of equal ratio between keys, of which none holds a hundredth of a source whatever the weights' scale, then
bins of the one in which the budget ends, so a source of any size is never sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.common import materialize, spread

#: The vocabulary file (ranks of a byte-level BPE), unless the session names another in TOKENIZER_SETTING; the
#: driver reads it and ships it with the job. The pattern that parts words is a fixed value.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER_SETTING = "spark.quarryline.tokenizer"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bins of keys for each doubling of the key, and parts of each bin. A key is exponential once the weight is
#: divided out, so no range of one part in 90 holds more than 0.41 % of the draws.
BINS, PARTS = 64, 4096
#: The mixture is as large as the caps let it be with all shares met.
SHARES = "shares"


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ship(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary to wherever tasks run; the name it has there."""
    spark.sparkContext.addFile(path)
    return Path(path).name


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [0 if t is None else sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["weight"], pa.array(n, pa.int64())], ["doc_id", "source", "weight", "tokens"])

    return run


def _pieces(text: str, size: int = 200_000) -> Iterator[str]:
    """A very long text in parts that end before white space, where no token crosses; without white space, whole."""
    at = 0
    while len(text) - at > size:
        cut = next((i for i in range(at + size, len(text)) if text[i] == " " and not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace()), None)
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def quality_weight(text: str = "text") -> Column:
    """From 0.05 to 1, the product of four signs of running text: the part of characters that are letters, the part
    of lines that aren't repeated, words of a usual length (3 to 10 letters on average, less the further from it),
    and enough words to say something (50, less in proportion). Null and empty texts have 0.05."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    words = F.greatest(F.size(F.split(F.trim(t), r"\s+")), F.lit(1))
    lines = F.filter(F.split(t, r"\s*[\r\n]+\s*"), lambda x: x != "")
    length = letters / words
    usual = F.least(F.lit(1.0), length / 3, F.greatest(F.lit(0.0), 2 - length / 10))
    fresh = F.coalesce(F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0))
    enough = F.least(F.lit(1.0), words / 50)
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(t), F.lit(0)), F.lit(0.0)) * fresh * usual * enough)


def budgets(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | str | None = None) -> dict[str, float]:
    """Tokens each source is to give. `size` is the mixture's, by default that of all targeted sources once.

    min(cap, level x share), with the level that makes the sum `size` (or all caps, if they are less). With SHARES
    it is the highest level at which no cap is passed, so sources with documents have their shares of each other.
    """
    have = [(s, share, totals.get(s, 0) * reps) for s, share, reps in targets if totals.get(s, 0) and reps and reps > 0 and share and share > 0]
    if size == SHARES:
        level = min((cap / share for _, share, cap in have), default=0.0)
        return {s: level * share for s, share, _ in have}
    size = min(size if size is not None else sum(totals.get(s, 0) for s, _, _ in have), sum(c for *_, c in have))
    out, left, open_ = {}, float(size), sorted(have, key=lambda x: x[2] / x[1])
    for k, (s, share, cap) in enumerate(open_):
        level = left / sum(x[1] for x in open_[k:])
        out[s] = min(float(cap), level * share)
        left -= out[s]
    return out


def token_counts(documents: DataFrame, tokenizer: str | None = None, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, weight, tokens), written once, of documents that have a source."""
    spark = documents.sparkSession
    name = _ship(spark, tokenizer or spark.conf.get(TOKENIZER_SETTING, TOKENIZER))
    rows = spread(documents.where(F.col("source").isNotNull())).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", (weight if weight is not None else quality_weight()).cast("double").alias("weight"), "text")
    return materialize(rows.mapInArrow(_counter(name), "doc_id bigint, source string, weight double, tokens bigint"), "tokens")


def _sums(rows: DataFrame, bin_: str, start: Column) -> DataFrame:
    """(source, ..., before, upto) of each bin: the tokens in front of it and up to its end. One source has as many
    bins as doublings of a double can give, and as many parts of one bin, and sources are as many as targets: so
    few that one task may number a source's bins, and that they may be broadcast."""
    by = list(dict.fromkeys(["source", "_bin", bin_]))
    sums = rows.groupBy(*by).agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.first(start).alias("start"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*by, "rest", (F.col("start") + earlier).alias("before"), (F.col("start") + earlier + F.col("n")).alias("upto"))


def mixture(documents: DataFrame, targets: DataFrame, size: int | str | None = None, seed: int = 1, tokenizer: str | None = None, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document of the mixture is used.

    `targets` (source, target_share, max_repeats) is one row for each source to mix, held by the driver;
    sources without a target, without documents or with no share give nothing. Documents without tokens
    come with their epochs. The document on which a budget ends is taken if that leaves the sum nearer to
    the budget. The draw depends on `seed` and the document's id and size only. `size`: tokens, SHARES, or
    that of all targeted sources.
    """
    return mix_counted(token_counts(documents, tokenizer, weight), targets, size, seed)


def mix_counted(docs: DataFrame, targets: DataFrame, size: int | str | None = None, seed: int = 1) -> DataFrame:
    """As `mixture`, of documents that `token_counts` has counted."""
    want = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect() if r["source"] is not None]
    known = docs.where(F.col("source").isin([s for s, *_ in want])) if want else docs.limit(0)
    totals = {r["source"]: int(r["n"] or 0) for r in known.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    reps = {s: r for s, _, r in want}
    plan = []
    for s, b in budgets(totals, want, size).items():
        epochs = min(int(b // totals[s]), reps[s])
        plan.append((s, epochs, b - epochs * totals[s] if epochs < reps[s] else 0.0))
    per_source = docs.sparkSession.createDataFrame(plan, "source string, epochs int, rest double")
    # u in (0, 1) from the id; the key -ln(u)/w is exponential with rate w. Equal ratios of keys are equal steps of `at`.
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tokens"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = known.join(F.broadcast(per_source), "source").withColumn("key", -F.log(u) / F.greatest("weight", F.lit(1e-9)))
    at = F.log2("key") * BINS
    drawn = drawn.withColumn("_bin", F.floor(at)).withColumn("_part", F.floor((at - F.floor(at)) * PARTS))
    bins = _sums(drawn, "_bin", F.lit(0))
    ending = bins.where("upto > rest AND before <= rest").select("source", "_bin", F.col("before").alias("start"))
    parts = _sums(drawn.join(F.broadcast(ending), ["source", "_bin"]), "_part", F.col("start"))
    placed = drawn.join(F.broadcast(bins.drop("rest")), ["source", "_bin"])
    placed = placed.join(F.broadcast(parts.select("source", "_bin", "_part", F.col("before").alias("_before"), F.col("upto").alias("_upto"))), ["source", "_bin", "_part"], "left")
    before, upto = F.coalesce("_before", "before"), F.coalesce("_upto", "upto")
    placed = placed.select("doc_id", "source", "tokens", "epochs", "rest", "key", before.alias("before"), F.when(upto <= F.col("rest"), 1).when(before > F.col("rest"), 0).alias("more"))
    run = F.col("before") + F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = placed.where("more IS NULL").withColumn("more", F.when((F.col("rest") > 0) & (run + F.col("tokens") / 2 <= F.col("rest")), 1).otherwise(0))
    both = placed.where("more IS NOT NULL").unionByName(last)
    return both.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) for every target. A source without
    documents has no share, and the others more than theirs."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    # One row for each target.
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return rows.select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies")
