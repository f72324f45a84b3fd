from __future__ import annotations

import random

import numpy as np
import pytest

from quarryline.llm import leakage
from quarryline.llm.leakage import MATCH, SCORE, align, codes, holds_stretch, leaked_items, words

VOCAB = [f"{a}{b}" for a in "ka lo mi nu re so ta vu".split() for b in "bar den fil gor hum jad kel".split()]


def passages(seed, n=20, size=70):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(VOCAB) for _ in range(size)) for _ in range(n)]


def edited(ws, rnd):
    """One word in eight replaced, dropped or added, never two of the first eight."""
    out = []
    for k in range(0, len(ws), 8):
        part = ws[k : k + 8]
        if len(part) == 8:
            i, how = rnd.randrange(8), rnd.choice("rda")
            part = part[:i] + ([] if how == "d" else ["zzz"] if how == "r" else [part[i], "zzz"]) + part[i + 1 :]
        out += part
    return out


def disguised(text, rnd):
    kind = rnd.randrange(6)
    if kind == 0:
        return text.upper()
    if kind == 1:
        return text.translate(str.maketrans("aeo", "аео"))
    if kind == 2:
        return "\n> ".join(text[i : i + 60] if False else w for i, w in enumerate(text.split()))
    if kind == 3:
        return "".join(c + "​" if rnd.random() < 0.2 else c for c in text)
    if kind == 4:
        return " ".join(f"**{w}**," if rnd.random() < 0.3 else w for w in text.split())
    return "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in text)


def cases(seed):
    rnd, items = random.Random(seed), passages(seed)
    docs, truth = [], set()
    for d in range(160):
        filler = lambda n: [f"w{rnd.randrange(9999)}" for _ in range(n)]
        i = rnd.randrange(len(items))
        ws = items[i].split()
        at = rnd.randrange(len(ws) - 40)
        if d % 3 == 0:
            part = ws[at : at + rnd.choice([24, 32, 40])]
            part = edited(part, rnd) if d % 2 else part
            text = " ".join(filler(30)) + ". " + disguised(" ".join(part), rnd) + ". " + " ".join(filler(20))
            truth.add((d, i))
        elif d % 3 == 1:
            text = " ".join(filler(20) + ws[at : at + rnd.randrange(3, 10)] + filler(20))
        else:
            text = " ".join(filler(50))
        docs.append((d, text, "e"))
    return docs, items, truth


def test_words():
    assert words("**Ａ** сор, eighty-eight <b>x</b> don't_go​!") == ["a", "cop", "eighty", "eight", "x", "don", "t", "go"]
    assert words(None) == words("") == []


def test_seeds_ignore_what_masks_leave_out():
    ws = 2 * np.arange(1, 25)
    assert [len(leakage._seeds(ws, m)[1]) for m in leakage.MASKS] == [19, 19, 18, 18]
    for mask in leakage.MASKS:
        assert "0" in mask
        other = np.where(np.array(list(mask)) == "1", ws[: len(mask)], 999)
        assert leakage._seeds(other, mask)[0][0] == leakage._seeds(ws, mask)[0][0]
        cut = ws.copy()
        cut[7] = 0
        assert len(leakage._seeds(cut, mask)[1]) == 25 - len(mask) - mask.count("1")
    assert len(leakage._seeds(ws[:4], "110111")[1]) == 0


def test_alignment():
    item = 2 * np.arange(100, 160)
    gone = leakage.EDIT / MATCH
    score = lambda part: align(part, item) / MATCH
    assert score(item[10:40]) == 30
    assert score(np.concatenate([item[:12], [2], item[13:30]])) == 29 - gone
    assert score(np.concatenate([item[:12], item[14:30]])) == 28 - 2 * gone
    assert score(np.concatenate([item[:12], [2, 4], item[12:30]])) == 30 - 2 * gone
    assert align(item[:9], item) == 18 < SCORE
    assert align(item[:0], item) == 0


def test_alignment_against_a_plain_table():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        a, b = (2 * rnd.integers(1, 6, rnd.integers(1, 30)) + (rnd.random() < 0.2) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        counts = lambda x: 1 - (x & 1)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                both = MATCH * counts(y) if x >> 1 == y >> 1 else -leakage.EDIT * max(counts(x), counts(y))
                t[i, j] = max(0, t[i - 1, j - 1] + both, t[i - 1, j] - leakage.EDIT * counts(x), t[i, j - 1] - leakage.EDIT * counts(y))
        assert align(a, b) == t.max()


def edit_at_random(ws, n, rnd):
    ws = list(ws)
    for _ in range(n):
        i, how = rnd.randrange(len(ws)), rnd.choice("rda")
        ws[i : i + 1] = [] if how == "d" else [f"zz{rnd.randrange(10**9)}"] if how == "r" else [ws[i], f"zz{rnd.randrange(10**9)}"]
    return ws


def bits_of(items):
    bits = np.zeros(leakage.FILTER_BITS // 8, np.uint8)
    for w in items:
        p = leakage._positive(leakage.all_seeds(w)[0])
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


@pytest.mark.parametrize(("size", "edits", "least"), [(20, 2, 0.99), (20, 3, 0.97), (21, 3, 0.97), (22, 3, 0.98), (24, 3, 0.99), (24, 4, 0.85), (28, 3, 0.99), (32, 4, 0.99), (48, 6, 0.99)])
def test_recall_by_length_and_edits(size, edits, least):
    """Of fresh items, stretches with words replaced, dropped and added anywhere, between other words."""
    rnd, items = random.Random(size * 100 + edits), passages(11)
    known = [codes(t) for t in items]
    bits, found, n = bits_of(known), 0, 200
    for k in range(n):
        i = rnd.randrange(len(items))
        ws = items[i].split()
        at = rnd.randrange(len(ws) - size)
        text = " ".join([f"w{j}" for j in range(30)] + edit_at_random(ws[at : at + size], edits, rnd) + [f"v{j}" for j in range(30)])
        found += any(align(w, known[i]) >= SCORE and holds_stretch(w, known[i]) for _, w, _, _ in leakage.stretches([codes(text)], bits))
    assert found >= least * n


def test_exact_stretches():
    item = 2 * np.arange(100, 160)
    cut = np.concatenate
    assert holds_stretch(item[10:30], item) and holds_stretch(item[10:27], item) and not holds_stretch(item[10:26], item)
    assert holds_stretch(cut([item[10:15], [2], item[16:22], [4], item[22:28], item[29:31]]), item)
    assert not holds_stretch(cut([item[10:15], [2], item[16:20], [4], item[21:25], [6], item[26:29], [8], item[30:32]]), item)
    assert not holds_stretch(item[:19], item[:19]) and not holds_stretch(item[:0], item)
    # 15 words and one edit, as sentences of one pattern have them, score enough but are no stretch.
    pattern = cut([[4], item[5:13], [2], item[14:20], [6]])
    assert align(pattern, item) >= SCORE and not holds_stretch(pattern, item)


def test_nine_words_in_a_row_are_no_case():
    rnd, items = random.Random(5), passages(12)
    known = [codes(t) for t in items]
    for k in range(200):
        ws = items[k % 20].split()
        at = rnd.randrange(len(ws) - 9)
        text = " ".join([f"w{j}" for j in range(30)] + ws[at : at + 9] + [f"v{j}" for j in range(30)])
        assert align(codes(text), known[k % 20]) < SCORE


@pytest.mark.parametrize("chars", [2_000_000, 500])
def test_found_pairs(spark, monkeypatch, chars):
    monkeypatch.setattr(leakage, "TEXT_CHARS", chars)
    docs, items, truth = cases(7)
    docs = docs + [(900, None, "e"), (901, "", "e"), (None, items[0], "e"), docs[0]] + [(902, "x " * 50_000 + items[3], "e")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    wanted = spark.createDataFrame([(i, t, "s") for i, t in enumerate(items)] + [(99, None, "s"), (98, "too short", "s"), (None, items[0], "s")], "item_id bigint, text string, doc_id string")
    got = [(r.doc_id, r.item_id) for r in leaked_items(documents, wanted).collect()]
    assert len(got) == len(set(got)) and set(got) == truth | {(902, 3)}
    assert leaked_items(documents.limit(0), wanted).collect() == [] == leaked_items(documents, wanted.limit(0)).collect()


def test_joined_words_count_once():
    item = codes("alpha beta sixty-three gamma delta " * 5)
    for form in ("sixty-three", "sixty three", "SIXTY‑THREE", "sixty-\nthree"):
        assert align(codes(f"x {('alpha beta ' + form + ' gamma delta ') * 5} y"), item) == 25 * MATCH
    # Two of twenty-five words replaced, both of them joined ones.
    text = ("alpha beta sixty-three gamma delta " * 5).replace("sixty-three", "other", 2)
    assert align(codes(text), item) == 23 * MATCH - 2 * leakage.EDIT


def test_copies_of_items_and_documents(spark):
    """Many copies are verified once, and every pair of them comes out."""
    text = passages(13)[0]
    documents = spark.createDataFrame([(d, text if d % 2 else f"{text} and more") for d in range(60)], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(i, text if i < 5 else passages(14)[0]) for i in range(6)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(documents, wanted).collect()} == {(d, i) for d in range(60) for i in range(5)}


def test_joins_lose_nothing(spark):
    """Filter, seed join and alignment of parts against alignment of everything."""
    docs, items, _ = cases(8)
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, e string")
    wanted = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = {(d, i): align(codes(t), codes(x)) / MATCH for d, t, _ in docs for i, x in enumerate(items)}
    got = {(r.doc_id, r.item_id): r.score for r in leaked_items(documents, wanted).collect()}
    assert got == {k: s for k, s in want.items() if s * MATCH >= leakage.CLEAR or s * MATCH >= SCORE and holds_stretch(codes(docs[k[0]][1]), codes(items[k[1]]))}
