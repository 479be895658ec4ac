"""Line deduplication by pairwise alignment.

A document is a list of line hashes. Two documents overlap where they share a block
of ``min_chars`` characters, and so a run: the fewest lines with that many characters
from a line on, or up to it. Every line of a block lies in a run within the block. A rare
run (in ``rare`` documents or fewer) pairs each of its documents with every earlier
one; a more frequent run pairs each of its documents with the earliest one, so that no
group of copies is expanded into pairs and no run is left out. The alignment is a
patience diff: common ends, then lines that are unique in both, in the longest
order that both have, and so on between them. Where two parts have no such line,
their common block of most characters is taken, if it has ``min_chars``, and so on beside it.
Aligned common blocks of ``min_chars`` or more are deleted from the later document.

Documents are ordered by id, then by a hash of their text. Defined results: a
null text is empty; blank lines are never evidence and go only inside a block;
rows with the same id and text are one document, rows with the same id and
other text are different documents; a null id comes first; an empty table gives
no rows; other columns are ignored. Positions are those of the ``\\n``-split lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textcodes


#: Tasks over which the documents of one run are dealt.
SALTS = 16
#: Lines whose runs are hashed at once; a single longer document is handled alone.
LINES = 1 << 18


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by the first, whose seconds increase."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _heaviest(a: list[int], b: list[int], chars: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """Places in both and number of lines of the common block that has most characters; ``chars`` are summed over ``b``.

    A suffix automaton of the one part reads the other, so that no pairs of equal lines are listed.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [alo]
    last = 0
    for i in range(alo, ahi):
        x, new, p = a[i], len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i + 1)
        while p >= 0 and x not in follow[p]:
            follow[p][x] = new
            p = link[p]
        if p >= 0:
            q = follow[p][x]
            if length[q] > length[p] + 1:
                twin = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and follow[p].get(x) == q:
                    follow[p][x] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
        last = new
    best, most, state, n = (alo, blo, 0), (0, 0), 0, 0
    for j in range(blo, bhi):
        while state and b[j] not in follow[state]:
            state = link[state]
            n = length[state]
        if b[j] in follow[state]:
            state = follow[state][b[j]]
            n += 1
        # Of equals the one nearest to the middle, so that many equal blocks halve the part.
        if n and (weight := (chars[j + 1] - chars[j + 1 - n], -abs(2 * j - blo - bhi))) > most:
            best, most = (end[state] - n, j + 1 - n, n), weight
    return best


def patience(a: list[int], b: list[int], sizes: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, in order; without unique lines, by blocks that have ``least`` by the sizes of ``b``."""
    out: list[tuple[int, int]] = []
    chars = [0, *accumulate(sizes or [1] * len(b))]
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        once: dict[int, int] = {}
        for i in range(alo, ahi):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict[int, int] = {}
        for j in range(blo, bhi):
            if once.get(b[j], -1) >= 0:
                seen[b[j]] = -1 if b[j] in seen else j
        anchors = _increasing(sorted((once[x], j) for x, j in seen.items() if j >= 0))
        if not anchors:
            # Only a stretch of lines that the other part has too can hold a block.
            held = most = 0
            for j in range(blo, bhi):
                held = held + chars[j + 1] - chars[j] if b[j] in once else 0
                most = max(most, held)
            if most >= least:
                i, j, n = _heaviest(a, b, chars, alo, ahi, blo, bhi)
                if n and chars[j + n] - chars[j] >= least:
                    out += [(i + k, j + k) for k in range(n)]
                    stack += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            continue
        i0, j0 = alo, blo
        for i, j in anchors:
            out.append((i, j))
            # What stands next to an anchor is taken by the common ends of the gap.
            stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        stack.append((i0, ahi, j0, bhi))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_chars: int) -> list[int]:
    """Positions in ``b`` of the aligned blocks that have ``min_chars`` characters or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b, sizes, min_chars), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= min_chars:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (id and text hash), ``lines`` (hashes, 0 for a blank line) and ``sizes``, once for each document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), F.split("text", "\n").alias("ls"))
    rows = rows.select(
        "key",
        F.transform("ls", lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)).otherwise(F.lit(0).cast("long"))).alias("lines"),
        F.transform("ls", lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.length(x)).otherwise(F.lit(0))).alias("sizes"),
    )
    return rows


def line_runs(lines: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of the distinct runs of each document; ``offsets`` are those of its lines."""
    n = len(lines)
    up, down = textcodes.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(textcodes.mix(lines.view(np.uint64)) * up[:n], out=total[1:])
    chars = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    i, least = np.flatnonzero(lines), max(min_chars, 1)
    end = np.searchsorted(chars, chars[i] + least, "left")
    start = np.searchsorted(chars, chars[i + 1] - least, "right") - 1
    on, back = end <= offsets[doc[i] + 1], start >= offsets[doc[i]]
    start, end, doc = np.concatenate([i[on], start[back]]), np.concatenate([end[on], i[back] + 1]), np.concatenate([doc[i[on]], doc[i[back]]])
    h = textcodes.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def overlapping_pairs(lines: DataFrame, rare: int, min_chars: int) -> DataFrame:
    """``later, earlier``: documents that share enough to be aligned."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("lines")
            offsets = column.offsets.to_numpy().astype(np.int64)
            values, sizes = (np.asarray(batch.column(c).values) for c in ("lines", "sizes"))
            lo = 0
            while lo < batch.num_rows:
                hi = max(int(np.searchsorted(offsets, offsets[lo] + LINES, "right")) - 1, lo + 1)
                of = slice(offsets[lo], offsets[hi])
                doc, h = line_runs(values[of], sizes[of], offsets[lo : hi + 1] - offsets[lo], min_chars)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(lo + doc)), pa.array(h.view(np.int64))], ["key", "run"])
                lo = hi

    spread = lines.select("key", "lines", "sizes").mapInArrow(runs, "key struct<doc_id:bigint,hash:bigint>, run long")
    known = spread.groupBy("run").agg(F.count("*").alias("k"), F.min("key").alias("first")).filter("k > 1")
    # Documents of one run are dealt over several tasks.
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = spread.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(known, ["run", "salt"])
    firsts = held.filter((F.col("k") > rare) & (F.col("first") < F.col("key"))).select(F.col("key").alias("later"), F.col("first").alias("earlier"))
    few = held.filter(F.col("k") <= rare)
    pairs = few.select("run", F.col("key").alias("later")).join(few.select("run", F.col("key").alias("earlier")), "run").filter("earlier < later").select("later", "earlier")
    return firsts.unionByName(pairs).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = 4, min_chars: int = 100) -> DataFrame:
    """``key, removed``: the sorted positions of the lines that go, for documents that lose any."""
    lines = common.staged(line_table(docs, doc_id, text).dropDuplicates(["key"]), "lines")
    pairs = overlapping_pairs(lines, rare, min_chars)
    both = pairs.join(lines.select(F.col("key").alias("later"), F.col("lines").alias("b"), "sizes"), "later")
    both = both.join(lines.select(F.col("key").alias("earlier"), F.col("lines").alias("a")), "earlier").select("later", "a", "b", "sizes")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k in range(batch.num_rows):
                a, b, sizes = (batch.column(c)[k].as_py() for c in ("a", "b", "sizes"))
                if gone := common_blocks(a, b, sizes, min_chars):
                    keys.append(k)
                    out.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("later").take(pa.array(keys, pa.int64())), pa.array(out, pa.list_(pa.int32()))], ["key", "gone"])

    gone = both.mapInArrow(align, "key struct<doc_id:bigint,hash:bigint>, gone array<int>")
    return gone.select("key", F.explode("gone").alias("i")).groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("removed"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = 4, min_chars: int = 100) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` (what is left) for every row of ``docs``."""
    gone = removed_lines(docs, doc_id, text, rare, min_chars)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    gone = gone.select(F.col("key.doc_id").alias("_id"), F.col("key.hash").alias("_hash"), "removed")
    joined = rows.join(gone, (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    ls = F.split("text", "\n")
    kept = F.array_join(F.filter(ls, lambda _, i: ~F.array_contains("removed", i)), "\n")
    return joined.select(
        "doc_id",
        F.size(ls).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
