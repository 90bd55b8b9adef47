"""Evaluation passages inside training documents.

Two passes over the documents, no shuffle of texts. The first counts in how many
documents each n-gram of the evaluation items occurs. From these counts every
stretch of WINDOW item words gets its rarest n-grams as seeds. The second pass
joins documents to items by seeds, and a Smith-Waterman alignment of words scores
each pair found. Copies edited everywhere may hold no seed: ``edited_items`` bounds
the alignment from above for every item, and all that can reach LEAST_SCORE are
aligned. The items are the stated query set: they travel to the workers in blocks of
bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.canonical import canonical_text
from lodestrata.session import materialize, ship, spread

#: Words of a seed.
GRAM = 4
#: So many consecutive words of an item are a leak; each such stretch has seeds.
WINDOW = 12
#: Words of items that the workers get at a time; larger sets take several passes.
BLOCK_WORDS = 2_000_000
#: Scores of the alignment of words.
MATCH, MISMATCH, GAP = 2, -2, -1
#: An alignment is a leak from this score on: what WINDOW equal words have.
LEAST_SCORE = MATCH * WINDOW

_WORD = re.compile(r"[^\W_]+")
_LINE_BREAK = re.compile(r"[-¬=‐‑­][ \t]*\r?\n")
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-¬=‐‑­][ \t]*\r?\n[ \t>|]*(?=[^\W\d_])")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def words_of(text: str, join: bool = True) -> list[str]:
    """Runs of letters and digits in lower case, disguises undone; ``join`` puts words divided at a line end together."""
    if join:
        text = _DIVIDED.sub("", text)
    if not text.isascii():
        text = canonical_text(text)
    return _WORD.findall(text.casefold())


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hash of the GRAM ids from each place on; 0 where one of them is 0 (no item word)."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = ids[k : k + n]
            whole &= part > 0
            out = (out ^ (part.astype(np.uint64) * _MIX[k])) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    out[~whole] = 0
    return out


def _postings(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where the items of each start, and the items."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    pairs = np.unique(np.stack([every, np.repeat(np.arange(len(keys)), [len(k) for k in keys])]), axis=1)
    found, first = np.unique(pairs[0], return_index=True)
    return found, np.append(first, pairs.shape[1]), pairs[1]


class Items:
    """A block of evaluation items: vocabulary, n-grams and, after ``choose``, seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.keys = [k for k, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws), 1)}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in self.words]
        grams = [_grams(i) for i in self.ids]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.at = [np.searchsorted(self.grams, g) for g in grams]
        base = len(self.vocabulary) + 1
        self.pairs = _postings([i[:-1] * base + i[1:] for i in self.ids])
        self.skips = _postings([i[:-2] * base + i[2:] for i in self.ids])
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.seed_grams = np.zeros(0, np.int64)

    def choose(self, documents: dict[int, int]) -> None:
        """Seeds: of every stretch the n-gram that the fewest documents hold; on a tie the one chosen before."""
        seeds: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for item, at in enumerate(self.at):
            counts = [documents.get(int(g), 0) for g in at]
            last = -1
            for start in range(max(1, len(at) - WINDOW + GRAM)):
                stretch = range(start, min(start + WINDOW - GRAM + 1, len(at)))
                if stretch:
                    last = min(stretch, key=lambda i: (counts[i], i != last, -i))
                    seeds[int(at[last])].add((item, last))
        self.seeds = {g: sorted(x) for g, x in seeds.items()}
        self.seed_grams = np.array(sorted(self.seeds), np.int64)

    def readings(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each reading, its text number, where it starts, and the ids of all words.

        A text with words divided at line ends is read a second time with the halves
        apart (a compound may be broken at its hyphen).
        """
        read: list[list[str]] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            if text:
                read.append(words_of(text, join=False))
                owner.append(i)
                if _LINE_BREAK.search(text):
                    read.append(words_of(text))
                    owner.append(i)
        get = self.vocabulary.get
        sizes = [len(w) + GRAM for w in read]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = np.zeros(int(starts[-1]), np.int64)
        for words, s in zip(read, starts, strict=False):
            ids[s : s + len(words)] = [get(w, 0) for w in words]
        return read, np.array(owner, np.int64), starts, ids

    def hits(self, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of item n-grams in readings: reading number, word number, n-gram number."""
        found = _grams(ids)
        at = np.flatnonzero(found)
        gram = np.searchsorted(self.grams, found[at])
        gram[gram == len(self.grams)] = 0
        real = self.grams[gram] == found[at] if len(self.grams) else np.zeros(0, bool)
        at, gram = at[real], gram[real]
        return np.searchsorted(starts, at, side="right") - 1, at, gram

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram numbers and the number of texts that hold each."""
        _, owner, starts, ids = self.readings(texts)
        reading, _, gram = self.hits(starts, ids)
        pairs = np.unique(np.stack([owner[reading], gram]), axis=1)
        return np.unique(pairs[1], return_counts=True)

    def edited_items(self, ids: np.ndarray) -> list[int]:
        """Items whose alignment with the words may reach LEAST_SCORE; no other item does.

        An alignment scores MATCH for its first match, and for each further one MATCH
        less at least one for every word skipped on either side since the match before.
        So a match adds 2 where it follows the item's word before it directly, 1 where
        one word is skipped, else nothing; and a run of words that the item lacks costs
        one from its third word on. The best stretch of this sum is the bound.
        """
        least, base = LEAST_SCORE - MATCH, len(self.vocabulary) + 1
        places, items, gains = [], [], []
        for gain, gap, (keys, first, posted) in ((1, 1, self.skips), (1, 2, self.pairs), (2, 1, self.pairs)):
            a, b = ids[:-gap], ids[gap:]
            at = np.flatnonzero((a > 0) & (b > 0))
            if not len(at) or not len(keys):
                continue
            key = a[at] * base + b[at]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            real = keys[k] == key
            at, k = at[real] + gap, k[real]
            n = first[k + 1] - first[k]
            places.append(np.repeat(at, n))
            items.append(posted[np.repeat(first[k + 1] - np.cumsum(n), n) + np.arange(n.sum())])
            gains.append(np.full(len(items[-1]), gain))
        if not items:
            return []
        place, item, gain = np.concatenate(places), np.concatenate(items), np.concatenate(gains)
        enough = np.bincount(item, gain, len(self.ids)) >= least
        kept = enough[item]
        place, item, gain = place[kept], item[kept], gain[kept]
        order = np.argsort(item, kind="stable")  # within an item the gains of 2 stay last and count
        place, item, gain = place[order], item[order], gain[order]
        numbers = np.flatnonzero(enough)
        edges = np.searchsorted(item, np.append(numbers, len(self.ids)))
        own = np.zeros(base, bool)
        found = []
        for number, low, high in zip(numbers.tolist(), edges[:-1], edges[1:], strict=True):
            own[self.ids[number]] = True
            lacking = ~own[ids]
            own[self.ids[number]] = False
            sums = np.zeros(len(ids), np.int64)
            sums[place[low:high]] = gain[low:high]
            sums[2:] -= lacking[2:] & lacking[1:-1] & lacking[:-2]
            total = np.concatenate([[0], np.cumsum(sums)])
            if (total - np.minimum.accumulate(total)).max() >= least:
                found.append(number)
        return found

    def leaks(self, texts: list[str | None], edited: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item key, score, matched words, longest run of consecutive item words).

        All pairs with WINDOW consecutive words; with ``edited`` all that score LEAST_SCORE too.
        """
        read, owner, starts, ids = self.readings(texts)
        reading, at, gram = self.hits(starts, ids)
        seeded = np.isin(gram, self.seed_grams)
        by: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for t, r, p, g in zip(owner[reading[seeded]], reading[seeded], at[seeded] - starts[reading[seeded]], gram[seeded], strict=True):
            for item, place in self.seeds[int(g)]:
                by[int(t), item, int(r)].append((int(p), place))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (t, item, r), seeds in by.items():
            for low, high in _regions(seeds, len(self.words[item])):
                words = read[r][max(0, low) : high]
                found = self._align(item, words)
                if found[0] >= LEAST_SCORE or found[2] >= WINDOW:
                    best[t, item] = max(best.get((t, item), (0, 0, 0)), found, key=lambda x: (x[2], x[0]))
        if edited:
            for r, words in enumerate(read):
                t = int(owner[r])
                for item in self.edited_items(ids[starts[r] : starts[r] + len(words)]):
                    found = self._align(item, words)
                    if found[0] >= LEAST_SCORE or found[2] >= WINDOW:
                        best[t, item] = max(best.get((t, item), (0, 0, 0)), found, key=lambda x: (x[2], x[0]))
        for (t, item), found in best.items():
            yield t, self.keys[item], *found

    def _align(self, item: int, words: list[str]) -> tuple[int, int, int]:
        get = self.vocabulary.get
        doc = np.array([get(w, 0) for w in words], np.int64)
        own = self.ids[item]
        score, matched, run = smith_waterman(own, doc)
        if run < WINDOW <= len(own) and _holds_stretch(self.words[item], words):
            run = WINDOW
        return score, matched, run


def _regions(seeds: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Stretches of words around seeds: each could hold the whole item with as many words again inserted."""
    regions: list[list[int]] = []
    for at, place in sorted(seeds):
        low, high = at - place - length // 2, at - place + length + length // 2
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
        else:
            regions.append([low, high])
    return [(a, b) for a, b in regions]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two id sequences: score and matched words; and the longest run of equal words.

    Id 0 of ``b`` matches nothing. One row at a time, so memory is a few rows of
    ``b`` however long ``a`` is; the gaps inside a row are a running maximum. Score
    and matches share a number, the score in its high part.
    """
    n = len(b)
    if not len(a) or not n:
        return 0, 0, 0
    unit = 1 << 20
    slope = np.arange(1, n + 1, dtype=np.int64) * (-GAP * unit)
    above, row, up = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs = np.zeros(n + 1, np.int64)
    tops, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    equal = np.zeros(n, bool)
    for code in a:
        np.equal(b, code, out=equal)
        np.add(above[:-1], MISMATCH * unit, out=row)
        row[equal] += (MATCH - MISMATCH) * unit + 1
        np.add(above[1:], GAP * unit, out=up)
        np.maximum(row, up, out=row)
        np.maximum(row, 0, out=row)
        row += slope
        np.maximum.accumulate(row, out=row)
        row -= slope
        above[1:] = row
        np.maximum(tops, row, out=tops)
        runs[1:] = (runs[:-1] + 1) * equal
        np.maximum(longest, runs[1:], out=longest)
    best = int(tops.max())
    return best // unit, best % unit, int(longest.max())


def _holds_stretch(item: list[str], words: list[str]) -> bool:
    """Whether WINDOW consecutive item words stand in ``words`` but for where words are divided."""
    stream, edges, at = "".join(words), {0}, 0
    for w in words:
        at += len(w)
        edges.add(at)
    for s in range(len(item) - WINDOW + 1):
        stretch = "".join(item[s : s + WINDOW])
        i = stream.find(stretch)
        while i >= 0:
            if i in edges and i + len(stretch) in edges:
                return True
            i = stream.find(stretch, i + 1)
    return False


def item_blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of at most ``block_words`` words (a single longer item is a block). Null texts are left out."""
    rows: list[tuple[int, str]] = []
    size = 0
    for r in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key).toLocalIterator():
        n = len(r[1]) // 2
        if rows and size + n > block_words:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield Items(rows)


LEAK_SCHEMA = "doc_id BIGINT, item_id BIGINT, score INT, matched INT, longest_run INT"


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", edited: bool = False) -> DataFrame:
    """One row per document and item of which it holds WINDOW consecutive words; with ``edited`` every pair whose alignment scores LEAST_SCORE as well.

    Columns of LEAK_SCHEMA: score of the alignment, words matched in it, and the
    longest run of consecutive item words. Null and empty documents hold nothing;
    without items the result is empty.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0))
    parts: list[DataFrame] = []
    # of several blocks one is on the workers at a time: each but the last is found and written before the next
    last: tuple[DataFrame, Broadcast] | None = None
    for block in item_blocks(items, item_key, item_text):
        if last:
            parts.append(materialize(last[0], "leaks"))
            last[1].unpersist()
        given = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gram, n = given.value.count(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

        counted = texts.mapInArrow(count, "gram BIGINT, n BIGINT").groupBy("gram").agg(F.sum("n").alias("n"))
        block.choose({r[0]: r[1] for r in counted.toLocalIterator()})  # at most as many rows as the block has n-grams
        given.unpersist()
        seeded = spark.sparkContext.broadcast(block)

        def leaks(batches: Iterator[pa.RecordBatch], given=seeded) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], *rest) for t, *rest in given.value.leaks(batch.column(1).to_pylist(), edited)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "matched", "longest_run"])

        last = texts.mapInArrow(leaks, LEAK_SCHEMA), seeded
    if not last:
        return spark.createDataFrame([], LEAK_SCHEMA)
    parts.append(last[0])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max(F.struct("longest_run", "score", "matched"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.matched", "b.longest_run")
