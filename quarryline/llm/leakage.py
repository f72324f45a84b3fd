"""Evaluation passages that stand, wholly or partly, in documents.

Words are compared after folding look-alikes, case, punctuation and markup away. Spaced seeds (fixed masks
over word positions, each of which ignores some) are hashed for all items and for every position of every
document, and the two are joined. Documents are read once: a filter of fixed size, made from the items' seeds,
keeps of each document only the stretches around seeds that may be some item's, as word hashes. Stretches and
items of one wording are looked at once, however many copies there are. Pairs with several seed places in
common are verified by an alignment with words replaced, dropped or added.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import materialize, spread
from quarryline.llm.lookalike import adopt, confusables, fold_long
from quarryline.operators.skew import fragment_replicate_join

# The masks; words at '0' are ignored.
MASKS = ("110111", "111011", "1101101", "1100111")
#: In an alignment a word in common counts MATCH and one replaced, dropped or added -EDIT. A stretch has 20 words
#: of the item or more, about an eighth of them edited; 20 with three edits have 17 in common, which makes the
#: least score. Nine words in a row, the most that is no case, have 18.
MATCH, EDIT = 2, 3
SCORE = 17 * MATCH - 3 * EDIT
#: Words of the shortest stretches, and how many of them may be edited ("about one in eight", taken generously).
#: Sentences of one pattern with other words in its places reach scores of little more than SCORE; below CLEAR a
#: pair must also show such a stretch exactly.
SHORTEST = ((20, 3), (24, 4))
CLEAR = 20 * MATCH
#: Seed places in common that make a pair worth an alignment. 98 in 100 stretches of 20 words with three random
#: edits have them, practically all longer ones and all with two edits (a test measures it).
PLACES = 2
#: Words around seed places that an alignment looks at, and the gap that parts two stretches of a document.
AROUND, GAP = 32, 48
#: Pairs aligned together; characters of documents whose words are handled together.
CHUNK, TEXT_CHARS = 256, 2_000_000
#: Bits of the filter (8 MB, whatever the number of items; the more items, the more it lets through).
FILTER_BITS = 1 << 26
_BUCKET = 32768  # bits of one bitmap of Spark's bitmap functions

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_WORD = re.compile(r"\x01?[^\W_]+")
_PAIR = re.compile(r"(?<![\w-])([^\W_]+)-([^\W_]+)(?![\w-])")
_SPAN = max(map(len, MASKS))
#: ASCII with everything but letters, digits and the mark of joined words as spaces.
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum() and c != 1}


def _marked(text: str | None) -> list[str]:
    """The words of a text; the second of two that a hyphen joins begins with \\x01."""
    if not text:
        return []
    s = _TAG.sub(" ", fold_long(text)).lower().replace("\x01", " ")
    s = _PAIR.sub("\\1 \x01\\2", s) if "-" in s else s
    return s.translate(_PLAIN).split() if s.isascii() else _WORD.findall(s)


def words(text: str | None) -> list[str]:
    return [w.lstrip("\x01") for w in _marked(text)]


class _Codes(dict):
    """Words as 64-bit numbers: a hash, whose lowest bit tells the second word of a joined pair. Such a word costs
    and counts nothing beside the first, so the pair counts as one word however the other side parts it."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        loose = word[0] == "\x01"
        code = self[word] = (xxhash.xxh3_64_intdigest(word.lstrip("\x01").encode("utf-8", "replace")) >> 1 | 2) & ~1 | loose
        return code


_CODES = _Codes()


def codes(text: str | None) -> np.ndarray:
    found = _marked(text)
    return np.fromiter((_CODES[w] for w in found), np.int64, len(found))


def _seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows whose unmasked words are all there (not 0), and where they start."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, ok = np.full(n, int(mask, 2), np.uint64), np.ones(n, bool)
    for k, bit in enumerate(mask):
        if bit == "1":
            w = ids[k : k + n]
            ok &= w != 0
            h = (h ^ (w >> 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    at = np.flatnonzero(ok)
    return h[at].view(np.int64), at


def all_seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [_seeds(ids, m) for m in MASKS]
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def _positive(h: np.ndarray) -> np.ndarray:
    """Where a seed falls in the filter."""
    return (h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % FILTER_BITS


def _keep(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    p = _positive(h)
    return (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def _finger(ids: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ids.tobytes())


def _lists(rows: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _items(shapes: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adopt(shapes)
        for b in batches:
            ids = [codes(t) for t in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["i"], pa.array([_finger(x) for x in ids], pa.binary()), _lists(ids)], ["i", "item", "item_words"])

    return run


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [all_seeds(np.asarray(w, np.int64)) for w in b["item_words"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["item"], _lists([h for h, _ in found]), _lists([at for _, at in found]), _lists([_positive(h) for h, _ in found])], ["item", "h", "at", "bit"])


def stretches(ids: list[np.ndarray], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(which document, words, seeds, their places) of the parts of documents that may hold an item."""
    starts = np.cumsum([0, *[len(x) + _SPAN for x in ids]])
    whole = np.zeros(starts[-1], np.int64)
    for a, x in zip(starts, ids):
        whole[a : a + len(x)] = x
    h, at = all_seeds(whole)
    some = _keep(h, bits)
    h, at = h[some], at[some]
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    doc = np.searchsorted(starts, at, "right") - 1
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > GAP)) + 1 if len(at) else []
    for group in np.split(np.arange(len(at)), cuts):
        if len(group) >= PLACES and np.count_nonzero(np.diff(at[group])) + 1 >= PLACES:
            d = doc[group[0]]
            a = max(starts[d], at[group[0]] - AROUND)
            z = min(starts[d] + len(ids[d]), at[group[-1]] + _SPAN + AROUND)
            yield d, whole[a:z], h[group], at[group] - a


def _reader(bits: Callable[[], np.ndarray], shapes: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adopt(shapes)
        for b in batches:
            docs, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and chars < TEXT_CHARS:
                    chars += len(texts[upto] or "")
                    upto += 1
                found = list(stretches([codes(t) for t in texts[at:upto]], bits()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[at + d] for d, *_ in found], pa.int64()), pa.array([_finger(w) for _, w, *_ in found], pa.binary()), *[_lists([f[k] for f in found]) for k in (1, 2, 3)]],
                    ["doc_id", "part", "words", "h", "place"])
                at = upto

    return run


def align(part: np.ndarray, item: np.ndarray) -> int:
    return align_all([part], [item])[0]


def align_all(parts: Sequence[np.ndarray], items: Sequence[np.ndarray]) -> list[int]:
    """The best local alignment's score of each pair. Pairs of like length are aligned together."""
    out = [0] * len(parts)
    order = sorted(range(len(parts)), key=lambda k: (len(parts[k]), len(items[k])))
    for at in range(0, len(order), CHUNK):
        some = [k for k in order[at : at + CHUNK] if len(parts[k]) and len(items[k])]
        if some:
            for k, s in zip(some, _align([parts[k] for k in some], [items[k] for k in some])):
                out[k] = int(s)
    return out


def _padded(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words (0 beyond the end), and 1 for each that counts."""
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out >> 1, ((out & 1) == 0) & (out != 0)


def _align(parts: Sequence[np.ndarray], items: Sequence[np.ndarray]) -> np.ndarray:
    """One step for each document word; along the items, words left out cost EDIT each, so the best way to come
    from the left is a running maximum. Beyond the ends nothing matches and nothing costs."""
    a, counts_a = _padded(parts)
    b, counts_b = _padded(items)
    n, m = b.shape
    kind = np.int16 if m * max(MATCH, EDIT) < 10_000 else np.int32
    gain, cost = MATCH * counts_b.astype(kind), EDIT * counts_b.astype(kind)
    ramp = np.cumsum(cost, axis=1, dtype=kind)
    score, best = np.zeros((n, m + 1), kind), np.zeros(n, kind)
    new = np.empty((n, m), kind)
    for w, counts in zip(a.T, counts_a.T):
        step = (EDIT * counts).astype(kind)[:, None]
        np.copyto(new, -np.maximum(cost, step))
        np.copyto(new, gain, where=(b == w[:, None]) & (w[:, None] != 0))
        new += score[:, :-1]
        np.maximum(new, score[:, 1:] - step, out=new)
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        np.subtract(new, ramp, out=score[:, 1:])
        np.maximum(best, score.max(axis=1), out=best)
    return best


def _windows(item: np.ndarray, words: int) -> list[np.ndarray]:
    """All runs of so many words that count, with the others among and right behind them."""
    at = np.flatnonzero((item & 1) == 0)
    ends = np.append(at, len(item))
    return [item[a:z] for a, z in zip(at, ends[words:])]


def holds_stretch(part: np.ndarray, item: np.ndarray) -> bool:
    """Whether one of the SHORTEST stretches of the item stands in `part` with no more than its words replaced,
    dropped or added."""
    return any(_least_edits(part, _windows(item, n), most) for n, most in SHORTEST)


def _least_edits(part: np.ndarray, found: list[np.ndarray], most: int) -> bool:
    if not found or not len(part):
        return False
    b, counts = _padded(found)
    cost = counts.astype(np.int32)
    ramp = np.cumsum(cost, axis=1)
    edits = np.concatenate([np.zeros((len(b), 1), np.int32), ramp], axis=1)
    for w in part:
        step = 1 - (int(w) & 1)
        new = np.minimum(edits[:, :-1] + np.where((b == w >> 1) & (b != 0), 0, np.maximum(cost, step)), edits[:, 1:] + step)
        new = np.minimum(np.minimum.accumulate(new - ramp, axis=1), 0) + ramp
        edits[:, 1:] = new
        if edits[:, -1].min() <= most:
            return True
    return False


def may_hold(part: np.ndarray, item: np.ndarray) -> bool:
    """False if no words of the item in a row have all but a few of them anywhere in `part`, as a stretch has."""
    there = set((part >> 1).tolist())
    run = np.cumsum([0, *[(w >> 1) in there for w in item.tolist() if not w & 1]])
    return any(len(run) > n and (run[n:] - run[:-n]).max() >= n - most for n, most in SHORTEST)


def _slices(col: pa.ListArray) -> list[np.ndarray]:
    values, ends = col.values.to_numpy(), col.offsets.to_numpy()
    return [values[a:z] for a, z in zip(ends, ends[1:])]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lo, hi, first, last = (b[c].to_pylist() for c in ("lo", "hi", "first", "last"))
        parts = [w[max(0, x - AROUND) : y + _SPAN + AROUND] for w, x, y in zip(_slices(b["words"]), lo, hi)]
        items = [w[max(0, x - AROUND) : y + _SPAN + AROUND] for w, x, y in zip(_slices(b["item_words"]), first, last)]
        asked = [k for k, (p, i) in enumerate(zip(parts, items)) if may_hold(p, i)]
        scores = np.zeros(len(parts), np.int64)
        scores[asked] = align_all([parts[k] for k in asked], [items[k] for k in asked])
        good = np.array([s >= CLEAR or s >= SCORE and holds_stretch(p, i) for s, p, i in zip(scores, parts, items)], bool)
        yield pa.RecordBatch.from_arrays([b["part"].filter(pa.array(good)), b["item"].filter(pa.array(good)), pa.array(scores[good] / MATCH, pa.float64())], ["part", "item", "score"])


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The filter's bits: combined in bitmaps of 4 KB in the map tasks, FILTER_BITS / 8 bytes at the driver at most."""
    bit = seeds.select(F.explode("bit").alias("b")).withColumn("b", F.col("b") + 1)
    maps = bit.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        bits[(r["n"] - 1) * _BUCKET // 8 : r["n"] * _BUCKET // 8] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score): documents with a stretch of an item, each pair once with its best score, in words.

    Null and empty texts hold nothing and aren't held. Items of fewer than 20 words can't leak. Two words that a
    hyphen joins in the item count as one. Seeds, items and stretches that very many others meet are split by
    estimated load and what they meet is replicated to the splits; a seed of many items and many stretches still
    makes as many pairs as it has of both, for which only those with PLACES places go on.
    """
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    shapes = confusables(documents.sparkSession)
    known = materialize(wanted.mapInArrow(_items(shapes), "i bigint, item binary, item_words array<bigint>"), "items")
    texts = materialize(known.groupBy("item").agg(F.first("item_words").alias("item_words")), "wordings")
    seeds = materialize(texts.mapInArrow(_item_seeds, "item binary, h array<bigint>, at array<bigint>, bit array<bigint>"), "seeds")
    shipped = documents.sparkSession.sparkContext.broadcast(_filter_of(seeds))

    docs = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    found = materialize(docs.mapInArrow(_reader(lambda: shipped.value, shapes), "doc_id bigint, part binary, words array<bigint>, h array<bigint>, place array<bigint>"), "parts")
    parts = found.groupBy("part").agg(F.first(F.struct("words", "h", "place")).alias("r")).select("part", "r.*")
    parts = materialize(parts, "stretches")

    theirs = parts.select("part", F.explode(F.arrays_zip("h", "place")).alias("s")).select("part", "s.h", "s.place")
    ours = seeds.select("item", F.explode(F.arrays_zip("h", "at")).alias("s")).select("item", "s.h", "s.at")
    met = fragment_replicate_join(theirs, ours, ["h"])
    # One row a place first, so that places are counted without a list of them.
    once = met.groupBy("part", "item", "place").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    pairs = once.groupBy("part", "item").agg(F.count(F.lit(1)).alias("places"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"))
    pairs = materialize(pairs.where(F.col("places") >= PLACES).drop("places"), "pairs")
    full = fragment_replicate_join(pairs.join(parts.select("part", "words"), "part"), texts, ["item"])
    sure = materialize(spread(full).mapInArrow(_verify, "part binary, item binary, score double"), "leaks")

    named = sure.join(known.select(F.col("i").alias("item_id"), "item"), "item").select("part", "item_id", "score")
    return fragment_replicate_join(found.select("doc_id", "part"), named, ["part"]).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
