"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item matches a document where some part of the document's text is within the
edit budget of the whole item: ``edits`` per character of the item. Both are
compared in lower case, with white space as single blanks. By the q-gram lemma
such a part shares ``m - q + 1 - q * e`` q-grams with an item of ``m`` characters and
``e`` edits, on diagonals that are at most ``e`` apart; so they all lie in one of the
bands that are two budgets wide and overlap by one.

For each run of texts: hash all q-grams, keep the places where enough of them
near each other occur in the benchmark at all, expand those to (item, diagonal),
count by band, and align the regions of bands that reach the bound. Nothing
is enumerated between documents; the only table that travels is the benchmark,
in blocks of ``block_chars``, and each block is matched with all documents.

Defined results: a null text is empty; an item with under ``min_chars`` characters
(or null) is too short to be evidence and matches nothing; equal items each match;
rows are independent, so repeated rows give repeated matches; an empty table, or
an empty benchmark, gives no rows; other columns are ignored. A match is
the best region of a band; overlapping regions of one item are one match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes

Q = 8
#: Characters of text that are handled at once; a longer text goes in overlapping parts.
PART = 1 << 20
_SPACES = np.array([9, 10, 11, 12, 13, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _lower_table(n: int = 0x590) -> np.ndarray:
    """Lower case of the code points below ``n`` whose lower case is one code point."""
    low = [c.lower() for c in map(chr, range(n))]
    return np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)


_LOWER = _lower_table()


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with white space as single blanks, and where each stood."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes < len(_LOWER)
    codes = np.where(small, _LOWER[np.where(small, codes, 0)], codes)
    blank = codes == 32
    odd = (codes < 14) & (codes > 8) | (codes > 132) & ~small | (codes == 133) | (codes == 160)
    if odd.any():
        blank |= odd & np.isin(codes, _SPACES)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    codes = np.where(blank, np.uint32(32), codes)
    at = np.flatnonzero(keep)
    return codes[at], at


def _grams(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(max(len(codes) - Q + 1, 0), np.uint64)
    for k in range(Q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + len(h)]
    return textcodes.mix(h)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], edits: float, min_chars: int):
        self.items = []
        for key, text in items:
            codes, _ = normalized((text or "").strip())
            if len(codes) >= min_chars:
                self.items.append((key, codes))
        self.size = np.array([len(c) for _, c in self.items], np.int64)
        self.budget = (self.size * edits).astype(np.int64)
        self.least = self.size - Q + 1 - Q * self.budget
        grams, item, pos = [], [], []
        for k, (_, codes) in enumerate(self.items):
            g = _grams(codes)
            grams.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
        if not self.items:
            return
        grams, item, pos = map(np.concatenate, (grams, item, pos))
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.cuts = np.append(first, len(order))
        self.item, self.pos = item[order], pos[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.grams >> np.uint64(44)] = True
        # Where an item matches, some stretch of this length has so many of its q-grams.
        self.stretch = int((self.size + self.budget).min())
        self.dense = int(min(-(-int(t) // -(-int(m + e) // self.stretch)) for t, m, e in zip(self.least, self.size, self.budget, strict=True)))

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, low, high)``: the stretches of ``codes`` that hold a band with enough q-grams."""
        if not self.items or len(codes) < Q:
            return []
        h = _grams(codes)
        hit = self.bits[h >> np.uint64(44)]
        # Places within a stretch that has enough hits.
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        w = min(self.stretch, len(h))
        ok = np.flatnonzero(total[w:] - total[:-w] >= self.dense)
        if not len(ok):
            return []
        near = np.zeros(len(h) + 1, np.int32)
        near[ok] += 1
        near[ok + w] -= 1
        at = np.flatnonzero(hit & (np.cumsum(near[:-1]) > 0))
        slot = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        true = self.grams[slot] == h[at]
        at, slot = at[true], slot[true]
        n = self.cuts[slot + 1] - self.cuts[slot]
        where = np.repeat(self.cuts[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, item = np.repeat(at, n), self.item[where]
        start = place - self.pos[where]
        # Each hit is in two bands of twice the width; together they hold every run of a budget's diagonals.
        width = self.budget[item] + 1
        band = (start + (1 << 40)) // width
        out = []
        for shift in (0, 1):
            key = np.stack([item, (band + shift) // 2 * 2 - shift])
            order = np.lexsort((place, key[1], key[0]))
            k0, k1, p, s = key[0][order], key[1][order], place[order], start[order]
            # A band runs through the whole text: it is cut where its hits are farther apart than an item is long.
            cut = np.flatnonzero(np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]) | (p[1:] - p[:-1] > self.size[k0[1:]])]))
            ends = np.append(cut[1:], len(p))
            full = ends - cut >= self.least[k0[cut]]
            for a, b in zip(cut[full], ends[full], strict=True):
                i = int(k0[a])
                # Enough hits within the length of a match, not only in the whole run.
                reach = int(self.size[i] + self.budget[i])
                q = p[a:b]
                t = int(self.least[i])
                tight = np.flatnonzero(q[t - 1 :] - q[: len(q) - t + 1] <= reach)
                if not len(tight):
                    continue
                # Consecutive matches of one band stay apart.
                group = np.split(tight, np.flatnonzero(np.diff(q[tight]) > reach // 2) + 1)
                for g in group:
                    lo_s, hi_s = s[a + g[0] : a + g[-1] + t].min(), s[a + g[0] : a + g[-1] + t].max()
                    low = max(0, int(lo_s) - int(self.budget[i]))
                    out.append((i, low, min(len(codes), int(hi_s) + reach + int(self.budget[i]))))
        return sorted(set(out))

    def align(self, i: int, region: np.ndarray) -> tuple[int, int, int] | None:
        """Edits, start and end of the best match of the item within the region, or None beyond the budget."""
        m, e = int(self.size[i]), int(self.budget[i])
        whole = self.items[i][1].tobytes()
        at = (raw := region.tobytes()).find(whole)
        while at % 4 and at >= 0:
            at = raw.find(whole, at + 1)
        if at >= 0:
            return 0, at // 4, at // 4 + m
        return banded(self.items[i][1], region, e) if len(region) >= m - e else None


def banded(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Semi-global alignment of the whole item with a part of the region, over the diagonals of a band.

    Row by row of the item; column ``d`` of a row is the diagonal ``d``, so the band has
    as many columns as the region is longer than the item, plus the budget on either side.
    """
    m, n = len(item), len(region)
    low, high = -budget, n - m + budget
    d = np.arange(low, high + 1)
    big = np.int64(1 << 20)
    cost = np.where((d >= 0) & (d <= n), 0, big)
    start = d.copy()
    for r in range(1, m + 1):
        col = d + r  # the number of region characters used
        inside = (col >= 1) & (col <= n)
        same = np.zeros(len(d), np.int64)
        same[inside] = (region[col[inside] - 1] != item[r - 1]).astype(np.int64)
        step = np.where(inside, cost + same, big)
        up = np.append(cost[1:], big) + 1
        take = up < step
        new = np.where(take, up, step)
        from_ = np.where(take, np.append(start[1:], 0), start)
        new = np.where((col >= 0) & (col <= n), new, big)
        # Insertions run along the row: the least of all to the left plus their distance.
        flat = new - d
        best = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat == best, np.arange(len(d)), 0))
        cost, start = best + d, from_[at]
        cost = np.where((col >= 0) & (col <= n), cost, big)
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(cost[k]), max(int(start[k]), 0), int(d[k] + m)


def _parts(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    part = max(PART, 2 * overlap)  # an item may be longer than PART
    for at in range(0, max(len(text) - overlap, 1), part - overlap):
        yield at, text[at : at + part]


def match_texts(index: Index, ids: list, texts: list[str]) -> Iterator[tuple]:
    """``(id, item key, start, end, edits)``; many short texts are laid end to end."""
    if not index.items:
        return
    overlap = int((index.size + 2 * index.budget).max()) * 4 + 64
    held: list[tuple[object, int, str]] = []
    size = 0

    def flush():
        joined = "￿".join(t for _, _, t in held)
        begins = np.cumsum([0] + [len(t) + 1 for _, _, t in held])
        codes, at = normalized(joined)
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for i, low, high in index.regions(codes):
            # A region stays within the text that holds its middle.
            k = int(np.searchsorted(begins, at[min((low + high) // 2, len(at) - 1)], "right")) - 1
            for j in {k, int(np.searchsorted(begins, at[low], "right")) - 1, int(np.searchsorted(begins, at[min(high, len(at)) - 1], "right")) - 1}:
                lo = max(low, int(np.searchsorted(at, begins[j])))
                hi = min(high, int(np.searchsorted(at, begins[j] + len(held[j][2]))))
                if got := index.align(i, codes[lo:hi]):
                    edits, a, b = got
                    if b > a:
                        found.setdefault((j, i), []).append((edits, lo + a, lo + b))
        for (j, i), spans in sorted(found.items()):
            best: list[tuple[int, int, int]] = []
            for edits, a, b in sorted(set(spans)):
                if all(b <= x or a >= y for _, x, y in best):
                    best.append((edits, a, b))
            for edits, a, b in sorted(best, key=lambda x: x[1]):
                doc, offset, _ = held[j]
                yield doc, index.items[i][0], int(at[a] - begins[j] + offset), int(at[b - 1] - begins[j] + offset + 1), edits

    for doc, text in zip(ids, texts, strict=True):
        for offset, part in _parts(text, overlap) if len(text) > PART else ((0, text),):
            held.append((doc, offset, part))
            size += len(part)
            if size >= PART:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = 0.08, min_chars: int = 32, block_chars: int = 8_000_000
) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for every match; positions are code points of the text."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    spark, schema = docs.sparkSession, "doc_id long, item_id long, start int, end int, edits int"

    def matched(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, edits, min_chars)
            for batch in batches:
                rows = set()
                for k, item, a, b, e in match_texts(index, list(range(batch.num_rows)), batch.column("text").to_pylist()):
                    rows.add((k, item, a, b, e))
                rows = sorted(rows, key=lambda x: (x[0], x[2], x[3], -1 if x[1] is None else x[1], x[4]))
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.int32()) for c in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"]
                )

        return docs.mapInArrow(run, schema)

    # The items come in blocks of bounded size; each is matched with all documents.
    out, block, size = None, [], 0
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if size >= block_chars:
            out = matched(block) if out is None else out.unionByName(matched(block))
            block, size = [], 0
    if block or out is None:
        out = matched(block) if out is None else out.unionByName(matched(block))
    return out
