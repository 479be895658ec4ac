"""Exact substring deduplication by deep-shallow suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too.
Sorting every suffix of a corpus is neither needed nor affordable, so suffixes
are first dealt to the groups in which their equals must be:

1. Equal texts are one text with a number of copies.
2. The window of ``length`` bytes at a position is addressed by the least hash of
   its ``GRAM``-byte strings, its anchor. Equal windows have the same anchor at the same
   offset, and neighbours mostly share one, so a run of about 75 windows is one
   record. Anchors that occur once in all texts are dropped.
3. The records of an anchor meet in one task. Their suffixes from the anchor on,
   and their prefixes before it read backwards, are sorted: a multikey quicksort,
   eight bytes at a time for all groups at once, down to ``SHALLOW`` bytes, and blind tries for the
   strings that still agree. The order gives the common prefixes, and these
   the windows that are equal, for each offset of the anchor.

All comparisons end on the bytes themselves. Defined results: a null text is
empty; texts under ``length`` bytes lose nothing; repeated rows are copies, whatever
their ids; ids are carried only; an empty table gives no rows; other columns are
ignored. A text longer than ``textcodes.PIECE`` is read in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes

GRAM = 48
SHALLOW = 64
#: Records that are sorted at once; a group is never split.
SORT_ROWS = 8192


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: text number, first and last start, anchor position, anchor hash."""
    n, w = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    up, down = textcodes.powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(textcodes._BYTE[data] * up[:n], out=total[1:])
    grams = textcodes.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # Least hash in each window of w grams, the leftmost of equals: the position is packed below the hash.
    high = np.uint64(0xFFFFFFFF00000000)
    key = (grams & high) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that lie within one text.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.flatnonzero(np.arange(starts) + length <= offsets[text + 1])
    if not len(inside):
        return none, none, none, none, none.astype(np.uint64)
    a, t = anchor[inside], text[inside]
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    last = np.append(cut[1:], len(inside)) - 1
    return t[cut], inside[cut], inside[last], a[cut], grams[a[cut]]


def text_runs(column: pa.Array, length: int) -> Iterator[tuple]:
    """``(texts, bytes, text, first, last, anchor, hash)`` for pieces of a column; a long text comes in several."""
    for first, last, data, offsets in textcodes.pieces(column):
        if last - first == 1 and len(data) > textcodes.PIECE:
            for at in range(0, len(data) - length + 1, textcodes.PIECE):
                part = data[at : at + textcodes.PIECE + length - 1]
                t, p, q, a, h = _runs(part, np.array([0, len(part)]), length)
                yield first, part, at, t, p, q, a, h
        else:
            t, p, q, a, h = _runs(data, offsets, length)
            yield first, data, -offsets[:-1], t, p, q, a, h


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """``h, d, again``: the distinct anchors of each text, and whether one occurs in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.asarray(batch.column("d"))
            for first, parts in groupby(text_runs(batch.column("text"), length), itemgetter(0)):
                # The parts of a long text are taken together; an anchor whose run goes on in the next part is one place.
                found = [(t, a + shift if np.isscalar(shift) else a, h) for _, _, shift, t, _, _, a, h in parts]
                t, a, h = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(t):
                    place = np.concatenate([[True], a[1:] != a[:-1]])
                    t, h = t[place], h[place]
                    order = np.lexsort((h, t))
                    t, h = t[order], h[order]
                    new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
                    at = np.flatnonzero(new)
                    again = np.diff(np.append(at, len(t))) > 1
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(d[first + t[at]]), pa.array(again)], ["h", "d", "again"])

    return texts.mapInArrow(run, "h long, d long, again boolean")


def _records(texts: DataFrame, length: int) -> DataFrame:
    """``h, key, content, left, at``: for the anchors listed in ``hs``, the bytes of all windows of each run.

    Rows without ``content`` are results: the text ``key`` repeats from ``at`` to ``end``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, listed = batch.column("key"), batch.column("hs")
            wanted: dict[int, np.ndarray] = {}
            for first, data, shift, t, p, q, a, h in text_runs(batch.column("text"), length):
                if not len(t):
                    continue
                if first not in wanted:
                    wanted.clear()  # only the parts of one long text come back
                hs = h.view(np.int64)
                keep = np.zeros(len(t), bool)
                for k in np.unique(t):
                    own = wanted.setdefault(first + int(k), np.asarray(listed[first + int(k)].as_py(), np.int64))
                    rows = slice(*np.searchsorted(t, [k, k + 1]))
                    keep[rows] = np.isin(hs[rows], own)
                t, p, q, a, hs = t[keep], p[keep], q[keep], a[keep], hs[keep]
                if not len(t):
                    continue
                raw = data.tobytes()
                start = p + (shift if np.isscalar(shift) else shift[t])
                content = [raw[x : y + length] for x, y in zip(p.tolist(), q.tolist(), strict=True)]
                # Equal records of one piece (copies of a passage, a period repeated in a text) are known to repeat:
                # one of them goes on to meet the rest, and what they cover is a result.
                seen: dict[tuple, int] = {}
                of = np.array([seen.setdefault(x, i) for i, x in enumerate(zip(hs.tolist(), (a - p).tolist(), content, strict=True))])
                twin = np.flatnonzero(np.bincount(of, minlength=len(of))[of] > 1)
                one = np.flatnonzero(of == np.arange(len(of)))
                for lo in range(0, len(one), 20_000):
                    i = one[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hs[i]), keys.take(pa.array(first + t[i])), pa.array([content[k] for k in i], pa.binary()), pa.array((a - p)[i].astype(np.int32)), pa.array(start[i]), pa.nulls(len(i), pa.int64())],
                        ["h", "key", "content", "left", "at", "end"],
                    )
                if len(twin):
                    tt, lo_, hi_ = t[twin], start[twin], start[twin] + (q - p)[twin] + length
                    cut = np.flatnonzero(np.concatenate([[True], (tt[1:] != tt[:-1]) | (lo_[1:] > hi_[:-1])]))
                    end = hi_[np.append(cut[1:], len(tt)) - 1]
                    spread = textcodes.mix((lo_[cut] + end * 31 + tt[cut]).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(spread), keys.take(pa.array(first + tt[cut])), pa.nulls(len(cut), pa.binary()), pa.nulls(len(cut), pa.int32()), pa.array(lo_[cut]), pa.array(end)],
                        ["h", "key", "content", "left", "at", "end"],
                    )

    return texts.mapInArrow(run, "h long, key binary, content binary, left int, at long, end long")


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length, by inserting them into a blind trie.

    A node is ``[depth, {byte: child}]`` and a leaf an index. Insertion goes down by
    branching bytes alone, compares once with the leaf that it reaches, and then
    knows the depth at which to branch.
    """
    root: object = 0
    n = len(strings[0])
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[node]
        lcp = n - ((int.from_bytes(s, "big") ^ int.from_bytes(other, "big")).bit_length() + 7) // 8
        parent, node = None, root
        while isinstance(node, list) and node[0] < lcp:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lcp:
            node[1][s[lcp]] = k
            continue
        branch = [lcp, {s[lcp]: k, other[lcp]: node}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings of one length within their groups (ascending numbers).

    Returns the order, and for each place the common prefix with the string before it
    (-1 where a group begins).
    """
    n, width = len(strings), len(strings[0])
    raw = np.frombuffer(b"".join(strings), np.uint8).reshape(n, width)
    words = np.ascontiguousarray(raw[:, : width // 8 * 8]).view(">u8").astype(np.uint64)
    order, part = np.arange(n), group.astype(np.int64)  # part: segment of the string at each place
    open_ = np.arange(n)
    for d in range(min(SHALLOW // 8, words.shape[1])):
        # Split the open segments by their next word, as a multikey quicksort does, all in one pass.
        w = words[order[open_], d]
        by = np.lexsort((w, part[open_]))
        order[open_], w, p = order[open_][by], w[by], part[open_][by]
        part[open_] = p
        cut = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        seg = np.cumsum(cut)
        sizes = np.bincount(seg)
        # Places of new segments get new numbers; those of one string are done.
        part[open_] = open_[np.flatnonzero(cut)][seg - 1] + n * (d + 1)
        open_ = open_[sizes[seg] > 1]
        if not len(open_):
            break
    if len(open_):
        seg = part[open_]
        cuts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(open_)), strict=True):
            at = open_[lo:hi]
            own = order[at]
            by_string: dict[bytes, list[int]] = {}
            for i in own.tolist():
                by_string.setdefault(strings[i], []).append(i)
            distinct = list(by_string)
            order[at] = [i for k in blind_trie_order(distinct) for i in by_string[distinct[k]]] if len(distinct) > 1 else own
    lcp = np.full(n, -1)
    if n > 1:
        for lo in range(1, n, 4096):
            hi = min(n, lo + 4096)
            differ = raw[order[lo:hi]] != raw[order[lo - 1 : hi - 1]]
            lcp[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        same = group[order[1:]] == group[order[:-1]]
        lcp[1:][~same] = -1
    return order, lcp


def repeated_windows(group: np.ndarray, contents: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each record the least and greatest anchor offset of its windows that occur elsewhere; -1 if none does."""
    low = np.array([int(x) + length for x in left]) - np.array([len(c) for c in contents])  # offset in the last window
    # Equal records have all their windows twice, and one of them stands for all in the sort.
    first: dict[tuple, int] = {}
    of = np.array([first.setdefault((g, x, c), i) for i, (g, x, c) in enumerate(zip(group.tolist(), left.tolist(), contents, strict=True))])
    copies = np.bincount(of, minlength=len(of))
    one = np.flatnonzero(copies)
    lo, hi = np.full(len(of), -1), np.full(len(of), -1)
    g = group[one]
    sizes = np.unique(g, return_counts=True)[1]
    several = one[np.repeat(sizes > 1, sizes)]
    if len(several):
        g, x = group[several], left[several]
        right = [contents[i][left[i] : left[i] + length].ljust(length, b"\0") for i in several]
        widest = length - GRAM
        back = [contents[i][: left[i]][::-1].ljust(widest + 8, b"\0") for i in several]
        ro, rl = deep_shallow(right, g)
        lo_, ll = deep_shallow(back, g)
        m = len(several)
        a, b = low[several], x
        found_lo, found_hi = np.full(m, -1), np.full(m, -1)
        rc, lc = np.empty(m, np.int64), np.empty(m, np.int64)
        for off in range(widest + 1):
            valid = np.flatnonzero((a <= off) & (off <= b))
            if len(valid) < 2:
                continue
            # Records agree on the window if they agree on what follows the anchor and on what precedes it.
            rc[ro] = np.cumsum(rl < length - off)
            lc[lo_] = np.cumsum(ll < off)
            both = rc[valid] * (m + 1) + lc[valid]
            by = np.argsort(both, kind="stable")
            s = both[by]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = valid[by[twice]]
            found_hi[hit] = off
            found_lo[hit] = np.where(found_lo[hit] < 0, off, found_lo[hit])
        lo[several], hi[several] = found_lo, found_hi
    twin = one[copies[one] > 1]
    lo[twin], hi[twin] = low[twin], left[twin]
    return lo[of], hi[of]


def _spans(records: DataFrame, length: int) -> DataFrame:
    """``key, start, end``: what the repeated windows of each record cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(t: pa.Table) -> list[pa.RecordBatch]:
            done = t.filter(t.column("content").is_null())
            t = t.filter(t.column("content").is_valid())
            if not t.num_rows:
                return done.select(["key", "at", "end"]).rename_columns(["key", "start", "end"]).combine_chunks().to_batches()
            h, left, at = (t.column(c).to_numpy() for c in ("h", "left", "at"))
            group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
            lo, hi = repeated_windows(group, t.column("content").to_pylist(), left.astype(np.int64), length)
            ok = np.flatnonzero(hi >= 0)
            anchor = at[ok] + left[ok]
            keys = t.column("key").combine_chunks().take(pa.array(ok))
            found = pa.table([keys, pa.array(anchor - hi[ok]), pa.array(anchor - lo[ok] + length)], ["key", "start", "end"])
            return pa.concat_tables([found, done.select(["key", "at", "end"]).rename_columns(["key", "start", "end"])]).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            h = batch.column("h").to_numpy(zero_copy_only=False)
            if rows >= SORT_ROWS and h[0] != h[-1]:
                # Whole groups are sorted now; the last one may go on in the next batch.
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
                held[-1] = batch.slice(0, cut)
                yield from sort(pa.Table.from_batches(held))
                held, rows = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from sort(pa.Table.from_batches(held))

    return records.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key binary, start long, end long")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Removes the spans of each text; a text with copies goes whole if it has ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textcodes.string_buffer(batch.column("text"))
            copies = batch.column("copies").to_pylist()
            spans = batch.column("spans")
            out = []
            for k in range(batch.num_rows):
                data = raw[offsets[k] : offsets[k + 1]]
                n = len(data)
                if copies[k] > 1 and n >= length:
                    merged = [(0, n)]
                else:
                    merged = []
                    for s in sorted((x["start"], x["end"]) for x in spans[k].as_py() or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                        else:
                            merged.append(s)
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a].tobytes())
                    at = b
                kept.append(data[at:].tobytes())
                out.append((n, sum(b - a for a, b in merged), merged, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), *(pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)),
                    pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in out], pa.string()),
                ],
                ["key", "n_bytes", "n_removed", "removed", "kept_sha256"],
            )

    return texts.mapInArrow(run, "key binary, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed, kept_sha256`` for every row; ``removed`` has the maximal runs in bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.unhex(F.md5(body.cast("binary"))).alias("key")).filter("key IS NOT NULL")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    found = anchors(rows.select(F.xxhash64("key").alias("d"), "text"), length)
    often = found.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.max("again").alias("again")).filter("a <> b OR again").select("h")
    listed = found.join(often, "h").groupBy("d").agg(F.collect_set("h").alias("hs"))

    # Both joins read the same columns of the texts by key, so that their exchange is made once.
    keys = rows.select("key").distinct().withColumn("d", F.xxhash64("key"))
    some = texts.join(listed.join(keys, "d").drop("d"), "key").select("key", "text", "copies", "hs")
    spans = _spans(_records(some, length), length).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = _cut(texts.join(spans, "key", "left").select("key", "text", "copies", "spans"), length)
    return rows.select("doc_id", "key").join(cut, "key").drop("key")
