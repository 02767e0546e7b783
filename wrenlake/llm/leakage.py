"""Evaluation texts inside a training corpus: BM25 over the test items with block-max WAND.

Plan: the parts of the test items (sentences, so question and answer apart, and the words round each border
of two sentences) form an inverted index: postings of term, part and impact, and postings of term, block of
parts and largest impact. The index is as large as the items' text; items beyond ``shard_chars`` characters
make further shards, each one more pass. Every document is cut into overlapping passages and every
passage is a query. A part's bar follows from the lowest score of twelve words in a row from it, so all that can be a
leak is retrieved: passages whose terms' bounds stay under the bar are skipped, so are blocks without any of the pivot
terms (those without which the bar is out of reach) and blocks whose bounds stay under it; only the rest is
scored. All parts above their bar are verified by runs and aligned words. Documents are never grouped, shuffled
or collected; a task holds one Arrow batch and one shard.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlake.llm.segment import item_sentences

PASSAGE, STRIDE = 24, 12
BLOCK = 2
#: kinds of parts: a sentence that may be reworded, one that must stand literally, words round a border
REWORDED, LITERAL, BORDER = 0, 1, 2
#: a sentence of fewer words must stand literally
REWORDED_WORDS = 8
K1 = 1.2
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯฀-๿]|[^\W_぀-ヿ㐀-鿿豈-﫿가-힯฀-๿]+")
_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]")
_HYPHENATED = re.compile(r"(?<=[a-zß-ÿ])[-‐‑]\s*\n\s*(?=[a-zß-ÿ])")
#: characters that are a word's part each; so many of them count as one word
_SIGNS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")
SIGNS_A_WORD = 1.7


def tokens(text: str) -> list[str]:
    """Words in one form: compatibility forms, case and marks folded; signs of scripts without blanks one by one."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _HYPHENATED.sub("", text)))
    elif "-\n" in text:
        text = _HYPHENATED.sub("", text)
    return _TOKEN.findall(text.casefold())


def weight(words: list[str]) -> float:
    """The number of words, signs counted by their share of one."""
    signs = sum(1 for w in words if _SIGNS.match(w))
    return len(words) - signs + signs / SIGNS_A_WORD


def parts_of(item: int, sentences: list[list[str]], run: int) -> list[tuple[int, list[str], int]]:
    """(item, words, kind) of an item's sentences and of the words round the borders between them."""
    words = [w for s in sentences for w in s]
    out = [(item, s, REWORDED if weight(s) >= REWORDED_WORDS else LITERAL) for s in sentences if s]
    at = 0
    for s in sentences[:-1]:
        at += len(s)
        near = words[max(0, at - 2 * run) : at + 2 * run]
        reach = round(run * (SIGNS_A_WORD if sum(map(bool, map(_SIGNS.match, near))) > len(near) / 2 else 1))
        out.append((item, words[max(0, at - reach + 1) : at + reach - 1], BORDER))
    return [p for p in out if p[1]]


class Level:
    """Postings of the parts whose bars are about the same, in blocks of ``BLOCK`` parts."""

    def __init__(self, parts: np.ndarray, bars: np.ndarray, terms: np.ndarray, of: np.ndarray, impacts: np.ndarray, vocabulary: int):
        order = np.argsort(bars[parts], kind="stable")
        self.parts = parts[order]  # numbers in the index
        self.n = len(parts)
        self.blocks = -(-self.n // BLOCK)
        self.bars = np.full(self.blocks * BLOCK, np.inf)
        self.bars[: self.n] = bars[self.parts]
        self.block_bars = self.bars.reshape(-1, BLOCK).min(axis=1)
        place = np.full(len(bars), -1)
        place[self.parts] = np.arange(self.n)
        mine = place[of] >= 0
        terms, at, impacts = terms[mine], place[of[mine]], impacts[mine]
        key = terms * (self.blocks * BLOCK) + at
        order = np.argsort(key)
        self.keys, self.impacts = np.r_[key[order], -1], np.r_[impacts[order], 0.0]  # one more for keys that aren't there
        block_key = terms[order] * self.blocks + at[order] // BLOCK
        first = np.flatnonzero(np.r_[True, block_key[1:] != block_key[:-1]]) if len(block_key) else np.zeros(0, "i8")
        most = np.maximum.reduceat(impacts[order], first) if len(first) else np.zeros(0)
        self.block_keys, self.block_max = np.r_[block_key[first], -1], np.r_[most, 0.0]
        self.starts = np.searchsorted(self.block_keys[:-1], np.arange(vocabulary + 2) * self.blocks)
        self.term_max = np.zeros(vocabulary + 1)
        np.maximum.at(self.term_max, terms, impacts)

    def above(self, passages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``passages``, parts) whose score reaches the part's bar."""
        slack = 1e-6
        bounds = self.term_max[passages]
        lowest = self.block_bars.min()
        rows = np.flatnonzero(bounds.sum(axis=1) >= lowest - slack)
        step = max(1, 2_000_000 // self.blocks)
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            of, words = bounds[some], passages[some]
            order = np.argsort(of, axis=1)
            sums = np.cumsum(np.take_along_axis(of, order, axis=1), axis=1)
            pivot = np.ones(of.shape, bool)
            np.put_along_axis(pivot, order, sums >= lowest - slack, axis=1)
            rest = np.where(pivot, 0.0, of).sum(axis=1)
            reach = self._walk(words, pivot & (of > 0))
            left = (reach > 0) & (reach + rest[:, None] >= self.block_bars - slack)
            if 8 * np.count_nonzero(left) > left.size:
                # so many blocks are left that walking the other terms' postings is cheaper than looking these up
                r, block = np.nonzero(left & (reach + self._walk(words, ~pivot & (of > 0)) >= self.block_bars - slack))
            else:
                r, block = np.nonzero(left)
                bound = self._sums(self.block_keys, self.block_max, words[r], self.blocks, block)
                enough = bound >= self.block_bars[block] - slack
                r, block = r[enough], block[enough]
            r, part = np.repeat(r, BLOCK), (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            for at in range(0, len(r), 65536):
                rr, pp = r[at : at + 65536], part[at : at + 65536]
                hit = self._sums(self.keys, self.impacts, words[rr], self.blocks * BLOCK, pp) >= self.bars[pp] - slack
                yield some[rr[hit]], self.parts[pp[hit]]

    def _walk(self, words: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Rows by blocks: the sums of the largest impacts of the terms marked in ``which``."""
        r, c = np.nonzero(which)
        t = words[r, c]
        begin, count = self.starts[t], self.starts[t + 1] - self.starts[t]
        where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cells = np.repeat(r, count) * self.blocks + self.block_keys[where] % self.blocks
        return np.bincount(cells, self.block_max[where], len(words) * self.blocks).reshape(len(words), self.blocks)

    def _sums(self, keys: np.ndarray, values: np.ndarray, words: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
        """Of each row of words the sum of the values at (word, at)."""
        r, c = np.nonzero(self.term_max[words] > 0)
        wanted = words[r, c] * base + at[r]
        found = np.searchsorted(keys[:-1], wanted)
        return np.bincount(r, np.where(keys[found] == wanted, values[found], 0.0), len(words))


class Index:
    """Postings of one shard. parts: (item_id, words, kind) each."""

    def __init__(self, parts: list[tuple[int, list[str], int]], share: float):
        self.items = np.array([p[0] for p in parts], "i8")
        self.words = [p[1] for p in parts]
        self.kinds = [p[2] for p in parts]
        self.weights = [weight(w) for w in self.words]
        n = len(parts)
        df: dict[str, int] = {}
        for w in self.words:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        self.vocab = {t: i for i, t in enumerate(sorted(df))}
        self.ids = [[self.vocab[t] for t in w] for w in self.words]
        self.bags = [Counter(w) for w in self.ids]
        self.signs = [sum(1 for t in w if _SIGNS.match(t)) > len(w) / 2 for w in self.words]
        length = max(1.0, float(np.mean([len(w) for w in self.words]))) if n else 1.0
        terms, of, impacts = [], [], []
        bars = np.zeros(n)
        for d, w in enumerate(self.words):
            norm = K1 * (0.25 + 0.75 * len(w) / length)
            own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf := w.count(t)) * (K1 + 1) / (tf + norm) for t in set(w)}
            terms += [self.vocab[t] for t in own]
            of += [d] * len(own)
            impacts += own.values()
            # what a passage scores at least that holds STRIDE words in a row of the part
            total = np.r_[0, np.cumsum([own[t] for t in w])]
            m = min(STRIDE, len(w))
            bars[d] = (total[m:] - total[:-m]).min() * (share if self.kinds[d] == REWORDED else 1)
        terms, of, impacts = np.array(terms, "i8"), np.array(of, "i8"), np.array(impacts, "f8")
        level = np.floor(np.log(np.maximum(bars, 1e-3)) / np.log(1.5)).astype("i8")
        self.levels = [Level(np.flatnonzero(level == x), bars, terms, of, impacts, len(self.vocab)) for x in np.unique(level)]

    def batch_leaks(self, docs: list[np.ndarray], run: int, kept: float) -> list[set[int]]:
        """Of each document's words the item ids that it holds. All passages of the batch are one query."""
        out: list[set[int]] = [set() for _ in docs]
        unknown = len(self.vocab)
        sizes = [max(1, -(-(len(d) - STRIDE) // STRIDE)) for d in docs]  # passages of each
        flat = np.full(STRIDE * (sum(sizes) + len(docs)), unknown, "i8")
        first, at = [], 0
        for d, n in zip(docs, sizes):
            first.append(at)
            flat[at * STRIDE : at * STRIDE + len(d)] = d
            at += n + 1
        halves = flat.reshape(-1, STRIDE)
        passages = np.hstack([halves[:-1], halves[1:]]) if len(halves) > 1 else np.zeros((0, PASSAGE), "i8")
        inside = np.ones(len(passages), bool)  # the last half of a document belongs to its last passage
        ends = np.array(first[1:], "i8") - 1
        inside[ends[ends < len(passages)]] = False
        rows = np.flatnonzero(inside)
        hits: dict[int, dict[int, list[int]]] = {}
        starts = np.array(first, "i8")
        for level in self.levels:
            for r, parts in level.above(passages[rows]):
                doc = np.searchsorted(starts, rows[r], side="right") - 1
                for i, d, s in zip(doc.tolist(), parts.tolist(), ((rows[r] - starts[doc]) * STRIDE).tolist()):
                    hits.setdefault(i, {}).setdefault(d, []).append(s)
        for i, candidates in hits.items():
            out[i] = self._verified(docs[i], candidates, run, kept)
        return out

    def _verified(self, ids: np.ndarray, candidates: dict[int, list[int]], run: int, kept: float) -> set[int]:
        """Item ids of which the text holds a sentence or a run of words.

        Items written after one pattern resemble each other: where reworded sentences claim the same
        stretch of text, those that fit it clearly worse than the best are no leak.
        """
        found: set[int] = set()
        claims: list[tuple[int, int, int, float]] = []
        for d, at in candidates.items():
            item, part, signs, kind = int(self.items[d]), self.ids[d], self.signs[d], self.kinds[d]
            if item in found and kind != REWORDED:
                continue
            bag, fits = self.bags[d], kept * len(part)
            least = len(part) if kind == LITERAL else min(run, fits) if kind == REWORDED else run
            for lo, hi in _spans(sorted(set(at)), len(part), len(ids)):
                text = ids[lo:hi].tolist()
                known = [t if t in bag else -1 for t in text]
                if len(known) - known.count(-1) < least:
                    continue
                seen = Counter(known)
                shared = sum(min(n, seen[t]) for t, n in bag.items())
                # no alignment or run keeps more words than both have
                if kind == LITERAL:
                    if shared == len(part) and _stands(part, text):
                        found.add(item)
                    continue
                ran = shared >= run and _stretch(known) >= run and _longest_run(text, part, self.words[d]) >= run
                if ran and not signs:
                    found.add(item)
                if kind == BORDER:
                    if ran and signs:
                        found.add(item)
                    continue
                if shared >= fits or (ran and signs):
                    fit, start, end = self._fit(d, text)
                    # where words are only estimated, a run competes like a reworded sentence
                    if fit >= kept or (ran and signs):
                        claims.append((item, lo + start, lo + end, fit))
        for item, lo, hi, fit in claims:
            rivals = (f for i, a, b, f in claims if i != item and min(hi, b) - max(lo, a) > 0.5 * (hi - lo))
            if fit >= max(rivals, default=0.0) - 0.06:
                found.add(item)
        return found

    def _fit(self, d: int, text: list[int]) -> tuple[float, int, int]:
        """The largest share of the sentence's words that a window of the text keeps in order."""
        n = len(self.ids[d])
        size, step = round(1.25 * n) + 2, max(1, n // 8)
        bits = _bits(self.ids[d])
        best = (0.0, 0, 0)
        for i in range(0, max(1, len(text) - size + step), step):
            best = max(best, (_common(bits, n, text[i : i + size]) / n, i, min(len(text), i + size)))
        return best


def _stretch(known: list[int]) -> int:
    """The most words in a row that are not -1."""
    best = now = 0
    for t in known:
        now = now + 1 if t >= 0 else 0
        if now > best:
            best = now
    return best


def _stands(part: list[int], text: list[int]) -> bool:
    """The words stand in the text in a row."""
    n = len(part)
    return any(text[i : i + n] == part for i in range(len(text) - n + 1))


def _spans(starts: list[int], length: int, n: int) -> list[tuple[int, int]]:
    """Stretches of text round passages, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for s in starts:
        lo, hi = max(0, s - length), min(n, s + PASSAGE + length)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _longest_run(text: list[int], ids: list[int], words: list[str]) -> float:
    """The weight of the longest run of words that both have."""
    where: dict[int, list[int]] = {}
    for j, t in enumerate(ids):
        where.setdefault(t, []).append(j)
    best, ended = 0.0, {}
    for t in text:
        now = {}
        for j in where.get(t, ()):
            now[j] = ended.get(j - 1, 0) + 1
            if now[j] > best:
                w = weight(words[j - now[j] + 1 : j + 1])
                best = max(best, w)
        ended = now
    return best


def _bits(ids: list[int]) -> dict[int, int]:
    bits: dict[int, int] = {}
    for j, t in enumerate(ids):
        bits[t] = bits.get(t, 0) | 1 << j
    return bits


def _common(bits: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    full = (1 << n) - 1
    v = full
    for t in text:
        m = bits.get(t, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - bin(v).count("1")


def leaked(
    documents: DataFrame, items: DataFrame, share: float = 0.75, run: int = 12, kept: float = 0.78, shard_chars: int = 16_000_000
) -> DataFrame:
    """(doc_id, item_id): documents that hold an item, one of its sentences or ``run`` words in a row from it.

    Case, marks, spacing and variants of characters don't matter; of a sentence, ``kept`` of its words in
    order are enough, but one of fewer than 8 words must stand literally. Null and empty texts and items give no
    row; repeated documents each have theirs. share: a passage and a sentence are compared from this share of the
    lowest BM25 score that a passage with twelve words in a row of the sentence can have.
    """
    columns = items.select(F.col("item_id").cast("long"), F.col("item_text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang")).where("item_text is not null")
    chars = columns.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    out = None
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    for shard in range(shards):
        part = columns.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id").collect()  # at most about shard_chars
        index = Index([p for r in part for p in parts_of(r.item_id, [tokens(s) for s in item_sentences(r.item_text, r.lang)], run)], share)
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run_shard(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix = shared.value
            unknown = len(ix.vocab)
            get = ix.vocab.get
            for b in batches:
                for lo in range(0, len(b), 512):
                    some = b.iloc[lo : lo + 512]
                    words = [np.array([get(t, unknown) for t in tokens(text)], "i8") for text in some["text"]]
                    rows = [(doc, i) for doc, found in zip(some["doc_id"], ix.batch_leaks(words, run, kept)) for i in found]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

        found = docs.mapInPandas(run_shard, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out
