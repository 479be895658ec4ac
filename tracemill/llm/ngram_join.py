"""Set-similarity join on word shingles by token-combination prefixes.

Two texts link when the Jaccard similarity of their shingle sets reaches the
threshold. Steps, none of which enumerates the pairs of a group:

1. Texts with equal sets are one class.
2. Shingles are counted over all texts. A counter is a sorted, delta-coded run of
   32-bit codes for each key range, about two bytes a shingle. Two tables of bounded
   size come of it: the most frequent codes, and a bitmap of codes seen twice.
3. Shingles are ordered rare first. Texts that link share at least k tokens in
   prefixes extended by k - 1; k grows from two with the length. Rare tokens are indexed singly, frequent ones by
   combinations of two; codes seen once can link nothing and are left out. The frequent tokens of a prefix are
   dealt by hash to fewer than k classes, so that two shared ones fall into one class: only pairs within a class are
   combined, and a text has about as many combinations as shingles, however long it is.
   Any order of the tokens gives complete candidates; the counts only make them few.
4. Candidates form groups; each group's sets meet in a task, where all pairs of them are verified. A group
   above ``block`` texts or ``block_shingles`` shingles is verified in pairs of blocks.

Defined results: a null or empty text, or one without words, has an empty set and
links with nothing; a text shorter than a shingle is one shingle of its
words; rows of one id are one document if their texts have equal sets and
are otherwise told apart by the sets; a row with a null id has its links like any other, but
a null id never becomes a component's id unless the component has no other; an empty table
gives no rows; other columns are ignored. Links are counted between rows, so copies of a
text count each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, textcodes

#: From this count on a token is frequent.
FREQUENT = 64
#: Largest number of frequent codes that are broadcast, 8 bytes each.
MAX_FREQUENT = 1 << 20
#: Bits of the bitmap of codes seen twice.
BITMAP_BITS = 27
#: Key ranges of the counter.
RANGES = 128


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """16 bytes that address a set."""
    out = []
    for s in sets:
        a = textcodes.mix(s + np.uint64(0x1234567))
        b = textcodes.mix(s ^ np.uint64(0x9E3779B97F4A7C15))
        out.append(np.array([a.sum(dtype=np.uint64) + np.uint64(len(s)), b.sum(dtype=np.uint64)], np.uint64).tobytes())
    return out


def _each(batches, width: int):
    """``(batch, first, last, sets)`` for runs of texts of bounded size."""
    for batch in batches:
        for first, last, data, offsets in textcodes.pieces(batch.column("text")):
            yield batch, first, last, textcodes.shingle_sets(data, offsets, width)


#: The prefix is extended so that linked texts share so many tokens in it: two, and one more for each so many shingles.
EXTEND_EACH = 50


def _shared(n: int, percent: int) -> int:
    """Tokens that linked texts, the smaller one of ``n`` shingles, have in both prefixes at least."""
    return min(2 + n // EXTEND_EACH, -(-n * percent // 100))


def _prefix(n: int, percent: int) -> int:
    """Tokens of the extended prefix."""
    return min(n, n - -(-n * percent // 100) + _shared(n, percent))


def combinations(top: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index keys of the frequent tokens in the prefix of a text of ``n`` shingles.

    A partner shares k of them at least, where k is that of the smallest text it can link with. Dealt to a power of two
    of classes under k, two of them fall together; the classes of a longer text divide those of a shorter one,
    so that both texts combine the two. Where k may be one, single tokens are keys as well.
    """
    k = _shared(-(-n * percent // 100), percent)
    keys = [textcodes.mix(top + np.uint64(0x5851F42D4C957F2D))] if k < 2 else []
    if _shared(n, percent) > 1 and len(top) > 1:
        classes = 1 << (max(k - 1, 1).bit_length() - 1)
        of = (textcodes.mix(top) & np.uint64(classes - 1)).astype(np.int64)
        order = np.lexsort((top, of))
        top, of = top[order], of[order]
        # Each token with those before it in its class, by distance.
        place = np.arange(len(top)) - np.searchsorted(of, of)
        for d in range(1, int(place.max()) + 1):
            j = np.flatnonzero(place >= d)
            keys.append(textcodes.mix(top[j - d] * np.uint64(3) + textcodes.mix(top[j])))
    return np.concatenate(keys) if keys else top[:0]


#: Two hashes that, beside the id, name the text of a row.
KEY = "k1 long, k2 long"


def class_rows(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, cls`` for every row; ``cls`` is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, sets in _each(batches, width):
            cls = [d if len(s) else None for d, s in zip(_digests(sets), sets, strict=True)]
            own = [batch.column(c).slice(first, last - first).cast(pa.int64()) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary())], ["doc_id", "k1", "k2", "n_shingles", "cls"])

    return docs.mapInArrow(run, f"doc_id long, {KEY}, n_shingles long, cls binary")


def _pack(codes: np.ndarray) -> bytes:
    """Sorted 32-bit codes as steps of two bytes, or four where a step is too long for two."""
    steps = np.diff(codes.astype(np.int64), prepend=0)
    if len(steps) > 1 and steps[1:].max() < 1 << 16:
        return b"2" + codes[:1].astype("<u4").tobytes() + steps[1:].astype("<u2").tobytes()
    return b"4" + codes.astype("<u4").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"4":
        return np.frombuffer(blob, "<u4", offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u4", 1, 1).astype(np.uint32), np.frombuffer(blob, "<u2", offset=5).astype(np.uint32)]), dtype=np.uint32)


def count_codes(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent codes with their counts, and the bitmap of codes seen twice; all of bounded size."""
    shift = 32 - int(math.log2(RANGES))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            cuts = np.searchsorted(codes >> np.uint32(shift), np.arange(RANGES + 1))
            rows = [(k, _pack(codes[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "codes"])

        held, size, seen = [], 0, set()
        for _, _, _, sets in _each(batches, width):
            for d, s in zip(_digests(sets), sets, strict=True):
                if len(s) and d not in seen:  # copies within a run count once
                    seen.add(d)
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
            if size > 1 << 23:
                yield flush(held)
                held, size, seen = [], 0, set()
        if held:
            yield flush(held)

    def total(t: pa.Table) -> pa.Table:
        codes = np.sort(np.concatenate([_unpack(x) for x in t.column("codes").to_pylist()]))
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        n = np.diff(np.append(at, len(codes)))
        codes = codes[at]
        bits = np.zeros((1 << BITMAP_BITS) // RANGES, bool)
        bits[(codes[n > 1] >> np.uint32(32 - BITMAP_BITS)) & np.uint32(len(bits) - 1)] = True
        often = n >= FREQUENT
        # Each range keeps its most frequent codes, so that all together stay within the bound.
        most = np.flatnonzero(often)
        if len(most) > MAX_FREQUENT // RANGES:
            most = most[np.argsort(-n[most], kind="stable")[: MAX_FREQUENT // RANGES]]
            most.sort()
        packed = np.packbits(bits).tobytes(), codes[most].astype("<u4").tobytes(), np.minimum(n[most], (1 << 32) - 1).astype("<u4").tobytes()
        columns = [pa.array([t.column("range")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
        return pa.Table.from_arrays(columns, ["range", "bits", "codes", "counts"])

    rows = docs.mapInArrow(partial, "range int, codes binary").groupBy("range").applyInArrow(total, "range int, bits binary, codes binary, counts binary").collect()
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    each = len(bitmap) // RANGES
    for r in rows:
        bitmap[r["range"] * each : (r["range"] + 1) * each] = np.frombuffer(bytes(r["bits"]), np.uint8)
    rows.sort(key=lambda r: r["range"])
    join = lambda col: np.frombuffer(b"".join(bytes(r[col]) for r in rows), "<u4")
    return join("codes"), join("counts"), bitmap


def prefix_rows(docs: DataFrame, width: int, percent: int, codes: np.ndarray, counts: np.ndarray, bitmap: np.ndarray) -> DataFrame:
    """``cls, n, rare, combos, has_frequent``: the index keys of every class, once for each run of rows."""
    tables = docs.sparkSession.sparkContext.broadcast((codes, counts, bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, bitmap = tables.value
        seen: set[bytes] = set()
        for _, _, _, sets in _each(batches, width):
            out = []
            for d, s in zip(_digests(sets), sets, strict=True):
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                code = (s >> np.uint64(32)).astype(np.uint32)
                p = _prefix(len(s), percent)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    often = codes[at] == code
                else:
                    often = np.zeros(len(s), bool)
                rare = s[~often][:p]
                top = np.zeros(0, np.uint64)
                if p > len(rare):
                    f = np.flatnonzero(often)
                    top = s[f[np.argsort(counts[at[f]], kind="stable")[: p - len(rare)]]]
                slot = (rare >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                rare = rare[(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
                combos = combinations(top, len(s), percent)
                if len(rare) or len(combos):
                    out.append((d, len(s), rare.view(np.int64), combos.view(np.int64), len(top) > 0))
            if len(seen) > 100_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()),
                        pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.int64())), pa.array([x[4] for x in out], pa.bool_()),
                    ],
                    ["cls", "n", "rare", "combos", "has_frequent"],
                )

    return docs.mapInArrow(run, "cls binary, n int, rare array<bigint>, combos array<bigint>, has_frequent boolean")


def candidate_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    """Edges between classes that may link; for frequent combinations and tokens, from each class to the least that has it."""
    one = prefixes.groupBy("cls").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("combos").alias("combos"), F.first("has_frequent").alias("has_frequent"))
    one = common.staged(one, "prefixes")
    # A token outside the table of frequent codes has fewer rows than each of the thousands that its range holds.
    of_token = Window.partitionBy("token")
    rare = one.select("cls", "n", "has_frequent", F.explode("rare").alias("token"))
    rare = rare.withColumns({"k": F.count("*").over(of_token), "least": F.min("cls").over(of_token)}).filter("k > 1")
    # A token that is frequent but has no place in the table of frequent codes is a star as well, never all pairs.
    wide = rare.filter(F.col("k") > FREQUENT).filter("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"))
    rare = rare.filter(F.col("k") <= FREQUENT)
    x = rare.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("has_frequent").alias("fa"))
    y = rare.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("has_frequent").alias("fb"))
    near = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = x.join(y, "token").filter(near).groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.first(F.col("fa") & F.col("fb")).alias("more"), F.first(F.least("na", "nb")).alias("n")
    )
    # As many tokens are shared as the shorter prefix is extended to share; some may be frequent ones.
    enough = F.least(2 + F.floor(F.col("n") / EXTEND_EACH), F.ceil(F.col("n") * percent / 100))
    pairs = pairs.filter((F.col("shared") >= enough) | F.col("more")).select("a", "b")
    combos = one.select("cls", F.explode("combos").alias("combo"))
    least = common.staged(combos.groupBy("combo").agg(F.min("cls").alias("b"), F.count("*").alias("k")).filter("k > 1"), "combos")
    stars = common.join_spread(combos, least, "combo", F.col("cls")).select(F.col("cls").alias("a"), "b").filter("a <> b")
    return pairs.unionByName(stars).unionByName(wide).distinct()


def verified_links(sets: list[np.ndarray], percent: int, weights: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first member of its component, and the summed weights of the sets that it links with.

    With ``first`` (booleans) only pairs of a first and another set are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.arange(n) if first is None else np.argsort(~first, kind="stable")
    sizes, own = sizes[order], [sets[k] for k in order]
    _, ids = np.unique(np.concatenate(own), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    root, mark, total = np.arange(n), np.zeros(ids.max() + 1, bool), np.zeros(n, np.int64)
    weight = weights[order]
    n_first = n if first is None else int(first.sum())
    for x in range(n_first):
        lo = x + 1 if first is None else n_first
        if lo == n:
            break
        mine = ids[cuts[x] : cuts[x + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[ids[cuts[lo] :]].astype(np.int32), cuts[lo:n] - cuts[lo])
        mark[mine] = False
        hit = lo + np.flatnonzero(100 * both.astype(np.int64) >= percent * (sizes[lo:] + sizes[x] - both))
        if len(hit):
            total[x] += weight[hit].sum()
            total[hit] += weight[x]
            met = np.zeros(n, bool)
            met[root[hit]] = met[root[x]] = True
            root[met[root]] = np.flatnonzero(met)[0]
    out_root, out_total = np.empty(n, np.int64), np.empty(n, np.int64)
    out_root[order], out_total[order] = order[root], total
    return out_root, out_total


def similarity_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, block: int = 2000, block_shingles: int = 1 << 22) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``."""
    if not 0 < percent <= 100:
        raise ValueError("the similarity is a percentage from 1 to 100")
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    rows = common.staged(class_rows(docs, width), "classes")
    codes, counts, bitmap = count_codes(docs.select("text"), width)
    edges = candidate_edges(prefix_rows(docs.select("text"), width, percent, codes, counts, bitmap), percent)
    groups = graph.components(edges)

    # Each class is represented by one of its rows; a large group is dealt over pairs of blocks.
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("row"), F.count("*").alias("k"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    classes = common.staged(classes, "sizes")
    members = groups.withColumnRenamed("node", "cls").join(classes.select("cls", "row", "k", "n"), "cls")
    sums = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("nb"))
    members = members.join(sums, "root").select("cls", "root", "nb", F.pmod(F.xxhash64("cls"), "nb").cast("int").alias("own"), F.col("k").alias("copies"), "row.*")
    at = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.k1") == F.col("m.k1")) & (F.col("d.k2") == F.col("m.k2"))
    texts = docs.alias("d").join(members.alias("m"), at).select("cls", "root", "nb", "own", "copies", "d.text")
    # Repeated rows have one id and text.
    texts = texts.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("root", "nb", "own", "copies", "text")])
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "copies", "text")

    def verify(t: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for first, last, data, offsets in textcodes.pieces(t.column("text")):
            sets += textcodes.shingle_sets(data, offsets, width)
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        first = None if i[0] == j[0] else own == i[0]
        none = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        if len(sets) < 2 or first is not None and (first.all() or not first.any()):
            return none
        root, n = verified_links(sets, percent, t.column("copies").to_numpy(), first)
        cls, some = t.column("cls").combine_chunks(), np.flatnonzero(n > 0)
        return pa.table({"a": cls.take(pa.array(some)), "b": cls.take(pa.array(root[some])), "n": pa.array(n[some])})

    found = common.staged(dealt.groupBy("root", "i", "j").applyInArrow(verify, "a binary, b binary, n long"), "links")
    roots = graph.components(found.filter("a <> b").select("a", "b")).select(F.col("node").alias("cls"), "root")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))

    # Ids and links are found by class, and dealt to the rows over several tasks for a class with many copies.
    linked = common.staged(classes.join(roots, "cls", "left").join(links, "cls", "left"), "linked")
    ids = linked.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(ids, "root", "left").select("cls", "k", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("k") - 1).alias("n_links"))
    known = common.staged(known, "known")
    full = common.join_spread(rows.filter("cls IS NOT NULL"), known, "cls", F.struct("doc_id", "k1")).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")
    return full.unionByName(rows.filter("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
