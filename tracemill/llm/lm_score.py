"""Language-model scoring with a small causal self-attention model in numpy.

Base: an add-one unigram model of words, whose counts are taken over all training
texts. Model: one causal self-attention layer over subword ids predicts the next subword: its
class, and within the class the subword, both from the last input and what attention brings. Only
the rare subwords, a class of their own, are told apart by how often they occur. A word's probability,
the product over its subwords, is mixed in equal parts with the base model's.

Texts are read for their subwords once and kept as ``Piece`` rows, from which words are counted, windows cut and texts scored.

The model learns from all training texts. Its subword counts and classes are
sums over all of them, and its weights take every window of every text, so that each subword
and each end is predicted once. They start from a fit on the driver to at most
``START_ROWS`` runs of windows, from texts of any length; then the runs are dealt by hash
to groups of about ``GROUP_WINDOWS``, each task takes every window of its group once, and the
parameters are averaged, ``MEANS`` groups at a time: an embedding by how often its subword is an input in the group,
all else by windows. Counts are summed in runs of rows before they
are shuffled. Frequent words, at most ``MAX_FREQUENT`` of them, travel to the tasks; words
that are rarer are looked up by a join, so no table that grows is broadcast.

A text is scored in windows of ``2 * STRIDE`` inputs that overlap by half: each
subword is predicted once, by the window that has it in its second half, with the
mask of causal attention in one batch for many windows. A window reaches back within its own text alone, so a
score depends on the text and the model only.

Defined results: a null text is empty and has the end token only; a null id is not
held out; repeated rows are scored alike and count as often as they occur; without
training texts every count is 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textcodes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
STRIDE = 16
DIM = 16
#: Classes of single frequent subwords, and of clusters of the others.
SINGLE, CLUSTERS = 40, 24
#: Subwords, the most frequent after the single ones, that are in a cluster and told apart by their context.
CLUSTERED = 1000
MAX_FREQUENT = 1 << 19
RANGES = 64
MIX = 0.5
#: Windows that one task takes, and that travel together; groups whose parameters are averaged together.
GROUP_WINDOWS = 1 << 18
RUN = 64
MEANS = 64
#: Runs of windows that the start is fitted to, and embeddings that are averaged together.
START_ROWS = 1024
BLOCK = 1024
#: Bound of each part of an exponent.
LIMIT = 35.0
#: Words whose subwords a task remembers.
CACHE = 300_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    n = max(ranks.values()) + 1
    opens = np.zeros(n, bool)
    opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    return tiktoken.Encoding("words", pat_str=r" ?[^ ]{1,48}", mergeable_ranks=ranks, special_tokens={}), n, opens


@dataclass
class Classes:
    """Classes of the subwords; those of a cluster have a slot in it, and ``cut`` has where each cluster's slots begin."""

    group: np.ndarray  # class of a subword
    within: np.ndarray  # log probability of a subword in its class by how often it occurs
    slot: np.ndarray  # place in its cluster, -1 where the class is one subword or the rare ones
    cut: np.ndarray
    members: np.ndarray  # the subwords of all slots


@dataclass
class Model:
    """The attention model as tables over subword ids; id ``n`` (the last) is the end of a text."""

    path: str
    n: int
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray  # class logits by the last input
    mixed: np.ndarray  # class logits by the attended value
    bias: np.ndarray  # attention bias by distance, masked
    inner: np.ndarray  # what tells the subwords of a class apart, by the last input
    inner_mixed: np.ndarray  # and by the attended value
    classes: Classes
    w: np.ndarray  # weights and bias of the subwords that are told apart
    w0: np.ndarray


def _within(classes: Classes, w: np.ndarray, w0: np.ndarray, y: np.ndarray, h: np.ndarray, grad: tuple | None = None) -> np.ndarray:
    """Log probability in its class of each subword that has a slot in a cluster, from the rows of ``h``.

    ``grad`` is ``(weight, dh, dw, dw0)``: the weighted gradients of the negated result are put into the last three.
    """
    slot, of = classes.slot[y], classes.group[y]
    order = np.argsort(of.astype(np.uint8), kind="stable")
    own_h = np.ones((len(y), h.shape[1] + 1), h.dtype)
    np.take(h, order, axis=0, out=(sorted_h := np.empty_like(h)), mode="clip")
    own_h[:, :-1] = sorted_h
    both = np.hstack([w, w0[:, None]])
    # The logits of all clusters lie end to end.
    n, cut = np.bincount(of - SINGLE, minlength=CLUSTERS)[: CLUSTERS - 1], np.append(classes.cut[1:], len(classes.members))[: CLUSTERS - 1]
    wide = np.diff(cut, prepend=0)
    ends, stop = np.cumsum(n), np.cumsum(n * wide)
    z, total, ones = np.empty(stop[-1], h.dtype), np.empty(len(y), h.dtype), np.ones(wide.max(), h.dtype)
    views = [
        (z[e - k * m : e].reshape(k, m), slice(b - k, b), slice(c - m, c))
        for k, m, e, b, c in zip(n.tolist(), wide.tolist(), stop.tolist(), ends.tolist(), cut.tolist(), strict=True) if k
    ]
    for own, at, members in views:
        np.matmul(own_h[at], both[members].T, out=own)
    target = np.repeat(stop - ends * wide, n) + np.arange(len(y)) * np.repeat(wide, n) + slot[order]
    found = z[target]
    np.exp(z, out=z)
    for own, at, _ in views:
        np.matmul(own, ones[: own.shape[1]], out=total[at])
    if grad is not None:
        weight, dh, dw, dw0 = grad
        weight = weight[order]
        share = (weight / total)[:, None]
        for own, at, _ in views:
            own *= share[at]
        z[target] -= weight
        d_both = np.zeros_like(both)
        for own, at, members in views:
            np.matmul(own, w[members], out=sorted_h[at])
            np.matmul(own.T, own_h[at], out=d_both[members])
        dh[order] = sorted_h
        dw[:], dw0[:] = d_both[:, :-1], d_both[:, -1]
    out = np.empty(len(y), h.dtype)
    out[order] = found - np.log(total)
    return out


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these lengths, laid end to end: the text and the first position of each window's second half."""
    n = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _causal() -> np.ndarray:
    """0 where query i of the second half may see input j of the window, else a large negative number."""
    i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
    return np.where(j <= i, 0.0, -1e9).astype(np.float32)


def token_scores(model: Model, tokens: np.ndarray, lengths: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Natural log probability of every token; each text's first input is the end token."""
    begins = np.cumsum(lengths) - lengths
    inputs = np.empty(len(tokens), np.int64)
    inputs[1:] = tokens[:-1]
    inputs[begins[lengths > 0]] = model.n
    text, first = _windows(lengths)
    out = np.empty(len(tokens), np.float32)
    half = np.arange(STRIDE)
    ones = np.ones(model.mixed.shape[1], np.float32)
    for lo in range(0, len(text), at_once):
        t, f = text[lo : lo + at_once], first[lo : lo + at_once]
        # The inputs in blocks of STRIDE, and the block before them: a window is two blocks side by side.
        back = max(lo - 1, 0)
        t_, f_ = np.append(text[back], t), np.append(first[back], f)
        at = (begins[t_] + f_)[:, None] + half
        ids = inputs[np.minimum(at, (begins + lengths - 1)[t_][:, None])]
        mine = ids[1:].ravel()
        key, value = (np.take(table, ids.ravel(), axis=0) for table in (model.key, model.value))
        key, value = (np.lib.stride_tricks.as_strided(x, (len(t), 2 * STRIDE, x.shape[1]), (STRIDE * x.strides[0], *x.strides), writeable=False) for x in (key, value))
        logits = np.matmul(np.take(model.query, mine, axis=0).reshape(len(t), STRIDE, DIM), key.transpose(0, 2, 1))
        logits += model.bias
        logits[f == 0, :, :STRIDE] = -1e9
        np.exp(logits, out=logits)
        # The last column of the values is 1 and gives the weights' sum.
        attended = np.matmul(logits, value).reshape(-1, DIM + 1)
        attended = attended[:, :DIM] / attended[:, DIM:]
        classes = np.take(model.out, mine, axis=0)
        classes += attended @ model.mixed
        rows = np.flatnonzero((at[1:] < (begins + lengths)[t][:, None]).ravel())
        where = at[1:].ravel()[rows]
        y = tokens[where]
        picked = classes[rows, model.classes.group[y]]
        np.exp(classes, out=classes)
        inside = model.classes.within[y]
        if len(some := np.flatnonzero(model.classes.slot[y] >= 0)):
            of = rows[some]
            h = np.take(attended, of, axis=0) @ model.inner_mixed
            h += np.take(model.inner, mine[of], axis=0)
            inside[some] = _within(model.classes, model.w, model.w0, y[some], h)
        out[where] = picked - np.log((classes @ ones)[rows]) + inside
    return out


class Words:
    """Subwords of words by the words' hashes, remembered up to a bound."""

    def __init__(self, path: str):
        self.encoding, self.end, self.opens = _encoding(path)
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        # Of the words in the order of their numbers, and of all their subwords; the first word is the end token.
        self.begin, self.size, self.flat = [np.zeros(1, np.int64)], [np.ones(1, np.int64)], [np.array([self.end], np.int64)]
        self.n_flat = 1

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        """All new words at once: a subword that begins with a blank begins a word."""
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int64)
        at = np.flatnonzero(self.opens[ids])
        first = len(self.known) + 1
        self.known.update(zip(hashes, range(first, first + len(hashes)), strict=True))
        self.begin.append(at + self.n_flat)
        self.size.append(np.diff(np.append(at, len(ids))))
        self.flat.append(ids)
        self.n_flat += len(ids)

    def subwords(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Subwords of all texts in a row, the number of each word, words by text, and the distinct words' hashes and numbers.

        Every text is followed by a word of its own, the end token.
        """
        h, text, start, end = textcodes.word_hashes(data, offsets)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.reset()
        hashes = uniq.tolist()
        slot = np.fromiter(map(self.known.get, hashes, repeat(-1)), np.int64, len(hashes))
        if len(new := np.flatnonzero(slot < 0)):
            raw = textcodes.LOWER[data].tobytes()
            slot[new] = len(self.known) + 1 + np.arange(len(new))
            self._learn(uniq[new].tolist(), [raw[s:e] for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            self.begin, self.size, self.flat = ([np.concatenate(x)] for x in (self.begin, self.size, self.flat))
        n_texts = len(offsets) - 1
        words = np.bincount(text, minlength=n_texts)
        seq = np.full(len(h) + n_texts, len(uniq))
        seq[np.arange(len(h)) + text] = inv
        number = np.append(slot, 0)[seq]
        lens, begin = self.size[0][number], self.begin[0][number]
        tokens = self.flat[0][np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
        return tokens, lens, words + 1, uniq, seq


@dataclass
class Piece:
    """Subwords of some texts in a row, the end token after each."""

    keys: np.ndarray
    training: np.ndarray  # whether a text is learned from
    tokens: np.ndarray
    lengths: np.ndarray  # of the texts, in subwords
    odd: np.ndarray  # places, among all words, of those that are no valid UTF-8, whose subwords do not tell them apart
    odd_h: np.ndarray  # and their hashes

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """The subwords and lengths of the texts that are learned from."""
        return self.tokens[np.repeat(self.training, self.lengths)], self.lengths[self.training]

    def words(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, each text's end a word too; how many subwords each word has, and how many words each text."""
        _, end, opens = _encoding(path)
        begins = opens[np.minimum(self.tokens, end - 1)] | (self.tokens == end)
        at = np.flatnonzero(begins)
        lens = np.diff(at, append=len(self.tokens))
        h = textcodes.run_hashes(self.tokens, at, lens)
        h[self.odd] = self.odd_h
        return h, lens, np.add.reduceat(begins, np.cumsum(self.lengths) - self.lengths, dtype=np.int64)


def _odd(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words that are no valid UTF-8."""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        h, text, start, end = textcodes.word_hashes(data, offsets)
        at = [k for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)) if raw[a:b].decode("utf-8", "ignore").encode() != raw[a:b]]
        return np.array(at, np.int64) + text[at], h[at]
    return np.zeros(0, np.int64), np.zeros(0, np.uint64)


def tokenized(texts: DataFrame, path: str) -> DataFrame:
    """The texts ``doc_id, k, training, text`` in pieces of about a megabyte, so that their subwords are looked for once: a ``Piece`` in a row, and its ids."""
    kind = dict(texts.dtypes)["doc_id"]
    names = ["ids", "k", "training", "tokens", "lengths", "odd", "odd_h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        narrow = np.uint16 if words.end < 1 << 16 else np.int32
        for batch in batches:
            ids, keys, training = batch.column("doc_id"), np.asarray(batch.column("k")).astype(np.int64), np.asarray(batch.column("training")).astype(bool)
            for first, last, data, offsets in textcodes.pieces(batch.column("text")):
                tokens, lens, per_text, _, _ = words.subwords(data, offsets)
                lengths = np.add.reduceat(lens, np.cumsum(per_text) - per_text)
                parts = keys[first:last], training[first:last], tokens.astype(narrow), lengths.astype(np.int32), *_odd(data, offsets)
                own = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), ids.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([own, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names)

    return texts.select("doc_id", "k", "training", "text").mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{n} binary" for n in names[1:]))


def _read(batch: pa.RecordBatch, end: int) -> Iterator[Piece]:
    """The pieces of rows of ``tokenized``."""
    kinds = np.int64, bool, np.uint16 if end < 1 << 16 else np.int32, np.int32, np.int64, np.uint64
    for row in zip(*(batch.column(c) for c in ("k", "training", "tokens", "lengths", "odd", "odd_h")), strict=True):
        keys, training, tokens, lengths, odd, odd_h = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds, strict=True))
        yield Piece(keys, training, tokens.astype(np.int64), lengths.astype(np.int64), odd, odd_h)


def _sequences(column: pa.Array, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Subwords of the texts in a row, what precedes each, and the texts' lengths in subwords, by pieces of the column."""
    for _, _, data, offsets in textcodes.pieces(column):
        tokens, lens, per_text, _, _ = words.subwords(data, offsets)
        lengths = np.add.reduceat(lens, np.cumsum(per_text) - per_text)
        inputs = np.empty(len(tokens), np.int64)
        inputs[1:] = tokens[:-1]
        inputs[np.cumsum(lengths) - lengths] = words.end
        yield tokens, inputs, lengths


def windows(tokens: np.ndarray, lengths: np.ndarray, end: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each window, and the number of its text: the subwords before and in it, then how many of the last it predicts and whether it is a text's first.

    ``keep`` gets the texts and the windows' numbers in them, and tells which rows are wanted.
    """
    begins = np.cumsum(lengths) - lengths
    text, first = _windows(lengths)
    if keep is not None:
        wanted = keep(text, first // STRIDE)
        text, first = text[wanted], first[wanted]
    place = first[:, None] + np.arange(-STRIDE - 1, STRIDE)
    rows = np.empty((len(text), 2 * STRIDE + 2), np.int32)
    rows[:, :-1] = np.where(place < 0, end, tokens[np.clip(begins[text][:, None] + place, 0, max(len(tokens) - 1, 0))]) if len(text) else 0
    rows[:, -1] = np.minimum(STRIDE, lengths[text] - first) + np.where(first == 0, 256, 0)
    return rows, text


def _frequent(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subwords that are classes of their own, and those that are clustered."""
    order = np.argsort(-counts, kind="stable")
    often = order[SINGLE : SINGLE + CLUSTERED]
    return order[:SINGLE], often[counts[often] >= 5]


def _contexts(counts: np.ndarray, tokens: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """How often each clustered subword follows each single one, or another."""
    single, often = _frequent(counts)
    slot, mark = np.full(len(counts), -1), np.full(len(counts), SINGLE)
    slot[often] = np.arange(len(often))
    mark[single] = np.arange(len(single))
    ok = slot[tokens] >= 0
    return np.bincount(slot[tokens[ok]] * (SINGLE + 1) + mark[inputs[ok]], minlength=len(often) * (SINGLE + 1))


def _near(table: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centre of each row that has room: as many rows go to each, so that no cluster costs much more than another. The first rows choose first."""
    prefer = np.argsort((centre**2).sum(axis=1) - table @ centre.T * 2, axis=1, kind="stable")
    room, near = [-(-len(table) // len(centre))] * len(centre), np.empty(len(table), np.int64)
    for k, choices in enumerate(prefer.tolist()):
        near[k] = c = next(c for c in choices if room[c])
        room[c] -= 1
    return near


def _cluster(counts: np.ndarray, contexts: np.ndarray, rng: np.random.Generator) -> Classes:
    """Classes of subwords: one each for the most frequent, clusters by what precedes them for the others, and one for the rare."""
    single, often = _frequent(counts)
    group, slot, cut, members = np.full(len(counts), SINGLE + CLUSTERS - 1), np.full(len(counts), -1), np.zeros(CLUSTERS, np.int64), np.zeros(0, np.int64)
    group[single] = np.arange(len(single))
    if len(often) > CLUSTERS:
        table = contexts.reshape(len(often), -1).astype(np.float64)
        table = np.sqrt(table / table.sum(axis=1, keepdims=True))
        centre = table[rng.choice(len(often), CLUSTERS - 1, replace=False)]
        for _ in range(12):
            near = _near(table, centre)
            for k in range(CLUSTERS - 1):
                if (near == k).any():
                    centre[k] = table[near == k].mean(axis=0)
        group[often] = SINGLE + near
        by = np.argsort(near, kind="stable")
        members, cut[1:] = often[by], np.cumsum(np.bincount(near, minlength=CLUSTERS - 1))
        slot[members] = np.arange(len(members)) - cut[near[by]]
    smooth = counts + 0.1
    within = np.log(smooth / np.bincount(group, smooth, minlength=SINGLE + CLUSTERS)[group]).astype(np.float32)
    return Classes(group, within, slot, cut, members)


def _distance() -> np.ndarray:
    """The bias of query i and input j depends on their distance."""
    return np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :], 0, 2 * STRIDE - 1)


def _start(counts: np.ndarray, classes: Classes, rng: np.random.Generator) -> dict[str, np.ndarray]:
    n_classes = SINGLE + CLUSTERS
    normal = lambda scale, *shape: rng.normal(0, scale, shape)
    p = {
        "E": normal(0.1, len(counts), DIM), "Q": normal(0.3, DIM, DIM), "K": normal(0.3, DIM, DIM), "V": normal(0.3, DIM, DIM), "C": normal(0.1, DIM, n_classes), "A": normal(0.1, DIM, n_classes),
        "c": np.log(np.bincount(classes.group, counts, minlength=n_classes) + 1.0), "b": np.zeros(2 * STRIDE),
        "H": normal(0.3, DIM, DIM), "G": normal(0.3, DIM, DIM), "W": normal(0.1, len(classes.members), DIM), "w": classes.within[classes.members],
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _summed(order: np.ndarray, cut: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows by the group of each: ``order`` puts the groups side by side, ``cut`` has where they begin."""
    # Two columns are added at once as one complex number.
    return np.add.reduceat(np.take(rows, order, axis=0).view(np.result_type(rows.dtype, np.complex64)), cut, axis=0).view(rows.dtype)


def _fit(p: dict[str, np.ndarray], classes: Classes, rows: np.ndarray, picks: Iterator[np.ndarray], steps: int, rate: float, attention: float = 1.0) -> None:
    """Fits the parameters in place to ``windows`` by Adam, in numpy; each of the picks is a step.

    What depends on the input alone is computed once for each distinct subword of a step. Exponents are kept from the limits of a float as in scoring.
    """
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    distance, mask, scale, kind = _distance(), _causal(), np.float32(1 / np.sqrt(DIM)), p["E"].dtype
    place, seen = np.zeros(len(p["E"]), np.int64), np.zeros(len(p["E"]), bool)
    for step, w in enumerate(picks):
        taken = np.take(rows, w, axis=0)
        ids, tokens, size, n = taken[:, : 2 * STRIDE], taken[:, STRIDE + 1 : -1].ravel(), taken[:, -1], len(w)
        ok, y, own = (np.arange(STRIDE) < (size & 255)[:, None]).ravel(), classes.group[tokens], np.arange(n * STRIDE)
        seen[ids] = True
        used = np.flatnonzero(seen)
        seen[used] = False
        place[used] = np.arange(len(used))
        back = place[ids]
        mine, e = back[:, STRIDE:], p["E"][used]
        query, key, value = e @ p["Q"] * scale, e @ p["K"], np.hstack([e @ p["V"], np.ones((len(used), 1), kind)])
        room = LIMIT / max(float(np.linalg.norm(key, axis=1).max()), 1e-6)
        query *= np.minimum(1, room / np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-6))
        q, k, v = (np.take(table, at, axis=0) for table, at in ((query, mine), (key, back), (value, back)))
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += (np.clip(p["b"], -LIMIT / 2, LIMIT / 2)[distance] + mask).astype(kind)
        s[size > 255, :, :STRIDE] = -1e9
        np.exp(s, out=s)
        # The last column of the values is 1 and gives the weights' sum.
        a = np.matmul(s, v)
        inverse = 1 / a[:, :, DIM:]
        # One row for each subword that is predicted: the last input, what attention brings, and 1.
        x = np.empty((n * STRIDE, 2 * DIM + 1), kind)
        x[:, :DIM], x[:, 2 * DIM] = np.take(e, mine.ravel(), axis=0), 1
        a = a[:, :, :DIM] * inverse
        x[:, DIM : 2 * DIM] = a.reshape(-1, DIM) * kind.type(attention)
        outer, inner = np.vstack([p["C"], p["A"], p["c"] - p["c"].max()]), np.vstack([p["H"], p["G"]])
        z = x @ outer
        np.clip(z, -2 * LIMIT, 2 * LIMIT, out=z)
        np.exp(z, out=z)
        # Backwards.
        weight = (ok / max(ok.sum(), 1)).astype(kind)
        z *= (weight / (z @ np.ones(z.shape[1], kind)))[:, None]
        z[own, y] -= weight
        dh, dw, dw0 = np.zeros((n * STRIDE, DIM), kind), np.zeros_like(p["W"]), np.zeros_like(p["w"])
        np.clip(p["W"], -5, 5, out=p["W"])
        if len(some := np.flatnonzero(classes.slot[tokens] >= 0)):
            part = np.empty((len(some), DIM), kind)
            _within(classes, p["W"], p["w"], tokens[some], np.take(x[:, : 2 * DIM] @ inner, some, axis=0), (weight[some], part, dw, dw0))
            dh[some] = part
        g_outer, g_inner = x.T @ z, x[:, : 2 * DIM].T @ dh
        g = {"C": g_outer[:DIM], "A": g_outer[DIM : 2 * DIM], "c": g_outer[2 * DIM], "H": g_inner[:DIM], "G": g_inner[DIM:], "W": dw, "w": dw0}
        dx = z @ outer[: 2 * DIM].T
        dx += dh @ inner.T
        # The gradient of the weights' sum is a further column beside that of the attended value.
        da = np.empty((n, STRIDE, DIM + 1), kind)
        np.multiply(dx[:, DIM:].reshape(a.shape), inverse * kind.type(attention), out=da[:, :, :DIM])
        np.negative(np.matmul((da[:, :, :DIM] * a).reshape(-1, DIM), np.ones(DIM, kind)).reshape(n, STRIDE), out=da[:, :, DIM])
        both = np.empty((n, 2 * STRIDE, 2 * DIM), kind)
        np.matmul(s.transpose(0, 2, 1), da[:, :, :DIM], out=both[:, :, DIM:])
        s *= np.matmul(da, v.transpose(0, 2, 1))
        np.matmul(s.transpose(0, 2, 1), q, out=both[:, :, :DIM])
        g["b"] = np.bincount(distance.ravel(), np.ones(n, kind) @ s.reshape(n, -1), minlength=2 * STRIDE)
        dq = np.empty((n, STRIDE, 2 * DIM), kind)
        np.matmul(s, k, out=dq[:, :, :DIM])
        dq[:, :, DIM:] = dx[:, :DIM].reshape(a.shape)
        # Sums by subword, then through the tables.
        of = back.ravel().astype(np.uint16) if len(used) < 1 << 16 else back.ravel()
        order = np.argsort(of, kind="stable")
        sums = _summed(order, np.searchsorted(of[order], np.arange(len(used))), both.reshape(-1, 2 * DIM))
        of = of.reshape(back.shape)[:, STRIDE:].ravel()
        order = np.argsort(of, kind="stable")
        by_group = of[order]
        cut = np.flatnonzero(np.concatenate([[True], by_group[1:] != by_group[:-1]]))
        own_sums = np.zeros((len(used), 2 * DIM), kind)
        own_sums[by_group[cut]] = _summed(order, cut, dq.reshape(-1, 2 * DIM))
        dk, dv, dq = sums[:, :DIM], sums[:, DIM:], own_sums[:, :DIM] * scale
        g["Q"], g["K"], g["V"] = e.T @ dq, e.T @ dk, e.T @ dv
        ge = dk @ p["K"].T + dv @ p["V"].T + dq @ p["Q"].T + own_sums[:, DIM:]
        now = rate * (1 - step / steps)
        for name, grad in [*g.items(), ("E", ge)]:
            of = used if name == "E" else slice(None)
            first[name][of] = m = 0.9 * first[name][of] + 0.1 * grad
            second[name][of] = r = 0.99 * second[name][of] + 0.01 * grad**2
            p[name][of] -= (now * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(r / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(kind)


def _model(path: str, p: dict[str, np.ndarray], classes: Classes, attention: float = 1.0) -> Model:
    mask, scale, distance, size = _causal(), np.float32(1 / np.sqrt(DIM)), _distance(), len(classes.group)
    query, key, value, out = p["E"] @ p["Q"] * scale, p["E"] @ p["K"], p["E"] @ p["V"], p["E"] @ p["C"] + p["c"] - p["c"].max()
    # Exponents stay far from the limits of a float, so that scoring needs no maximum: long queries are shortened.
    room = LIMIT / max(float(np.linalg.norm(key, axis=1).max()), 1e-6)
    norm = np.linalg.norm(query, axis=1, keepdims=True)
    query *= np.minimum(1, room / np.maximum(norm, 1e-6))
    np.clip(out, -LIMIT, LIMIT, out=out)
    mixed = p["A"] * np.float32(attention * min(1.0, LIMIT / max(float(np.abs(value @ p["A"]).max()), 1e-6)))
    bias = (np.clip(p["b"], -LIMIT / 2, LIMIT / 2)[distance] + mask).astype(np.float32)
    inner, inner_mixed = p["E"] @ p["H"], p["G"] * np.float32(attention)
    # The same for the subwords within a class.
    far = float(np.abs(p["W"]).sum(axis=1).max()) if len(p["W"]) else 0.0
    inner = np.clip(inner, -LIMIT / max(far, 1.0), LIMIT / max(far, 1.0))
    inner_mixed *= np.float32(min(1.0, LIMIT / max(far * float(np.abs(value @ p["G"]).max()), 1e-6)))
    value = np.hstack([value, np.ones((size, 1), np.float32)])
    return Model(path, size - 1, query, key, value, out, mixed, bias, inner, inner_mixed, classes, p["W"], p["w"])


def train(texts: list[str], path: str = TOKENIZER, steps: int = 400, batch: int = 512, rate: float = 0.01, seed: int = 5, attention: bool = True) -> Model:
    """A model of these texts alone; without ``attention`` it sees the last input only."""
    rng, words = np.random.default_rng(seed), Words(path)
    parts = list(_sequences(pa.array(texts, pa.string()), words))
    tokens, inputs, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = np.bincount(tokens, minlength=words.end + 1)
    classes = _cluster(counts, _contexts(counts, tokens, inputs), rng)
    p, (rows, _) = _start(counts, classes, rng), windows(tokens, lengths, words.end)
    _fit(p, classes, rows, (rng.integers(0, len(rows), batch) for _ in range(steps)), steps, rate, float(attention))
    return _model(path, p, classes, float(attention))


def _packed_runs(tokens: np.ndarray, lengths: np.ndarray, end: int, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The windows from number ``first`` up to ``last`` of these texts, each subword once: a header, what is before them, and what they predict.

    The header is the size of the last window, and 256 more where the first is its text's first.
    """
    kind = np.dtype(np.uint16 if end < 1 << 16 else np.int32)
    ahead, begins = STRIDE + 1, np.cumsum(lengths) - lengths
    laid = np.full(len(tokens) + ahead * len(lengths), end, kind)
    laid[np.arange(len(tokens)) + np.repeat(ahead * np.arange(1, len(lengths) + 1), lengths)] = tokens
    predicted = np.minimum(last * STRIDE, lengths[text]) - first * STRIDE
    sizes = predicted + ahead + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.empty(offsets[-1], kind)
    # One place before the run's own is read too, and has the header.
    from_ = begins[text] + ahead * text + first * STRIDE - 1
    data[:] = laid[np.maximum(np.arange(len(data)) + np.repeat(from_ - offsets[:-1], sizes), 0)]
    data[offsets[:-1]] = (predicted - 1) % STRIDE + 1 + np.where(first == 0, 256, 0)
    return pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((offsets * kind.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: list[bytes], end: int = 0) -> np.ndarray:
    """The ``windows`` of packed runs; ``end`` tells how wide their subwords are."""
    if not column:
        return np.empty((0, 2 * STRIDE + 2), np.int32)
    kind, ahead = np.dtype(np.uint16 if end < 1 << 16 else np.int32), STRIDE + 1
    sizes = np.array([len(x) for x in column]) // kind.itemsize
    data = np.frombuffer(b"".join(column), kind)
    begins = np.cumsum(sizes) - sizes
    n = -(-(sizes - ahead - 1) // STRIDE)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # A last window that is not full is filled with the last subword.
    at = (np.repeat(begins + 1, n) + number * STRIDE)[:, None] + np.arange(2 * STRIDE + 1)
    rows = np.empty((len(at), 2 * STRIDE + 2), np.int32)
    rows[:, :-1] = data[np.minimum(at, np.repeat(begins + sizes - 1, n)[:, None])]
    header, final = np.repeat(data[begins].astype(np.int32), n), number == np.repeat(n - 1, n)
    rows[:, -1] = np.where(final, header & 255, STRIDE) + np.where((number == 0) & (header > 255), 256, 0)
    return rows


def window_rows(texts: DataFrame, path: str, share: int, subwords: np.ndarray) -> DataFrame:
    """``k, run, w, i, n``: one of ``share`` windows of each of the texts ``k, text``, in packed runs; which ones, the hash ``k`` decides.

    Rows with ``i`` add ``n`` to the place ``i`` of the classes' ``_contexts``, which are summed over all texts.
    """
    return _window_rows(tokenized(texts.select("k", "text", F.lit(0).alias("doc_id"), F.lit(True).alias("training")), path), share, subwords)


def _window_rows(pieces: DataFrame, share: int, subwords: np.ndarray) -> DataFrame:
    names, end = ["k", "run", "w", "i", "n"], len(subwords) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = 0
        for batch in batches:
            for piece in _read(batch, end):
                tokens, lengths = piece.learned()
                if not len(lengths):
                    continue
                inputs = np.empty(len(tokens), np.int64)
                inputs[1:] = tokens[:-1]
                inputs[np.cumsum(lengths) - lengths] = end
                contexts = contexts + _contexts(subwords, tokens, inputs)
                own = piece.keys[piece.training]
                # Adjacent windows, at most RUN of them, are a run.
                text, first = _windows(lengths)
                wide, number = RUN if share == 1 else 1, first // STRIDE
                begin = np.flatnonzero((number + own[text] % share) % share == 0 if share > 1 else number % RUN == 0)
                text, number = text[begin], number[begin]
                last = np.minimum(number + wide, -(-lengths[text] // STRIDE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[text]), pa.array(number.astype(np.int64)), _packed_runs(tokens, lengths, end, text, number, last), pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.int64())], names
                )
        if len(at := np.flatnonzero(contexts)):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(at.astype(np.int32)), pa.array(contexts[at].astype(np.int64))], names)

    return pieces.drop("ids").mapInArrow(run, "k long, run long, w binary, i int, n long")


def start_runs(runs: DataFrame) -> DataFrame:
    """At most ``START_ROWS`` of the runs, by their hash. Only about twice as many are put in order, so that not each task sends that many."""
    number = F.xxhash64("k", "run")
    if (n := runs.count()) > 2 * START_ROWS:
        runs = runs.filter(F.shiftrightunsigned(number, 33) < -(-(START_ROWS << 32) // n))
    return runs.orderBy(number, "k", "run", "w").limit(START_ROWS).select("w")


def learned(runs: DataFrame, groups: int, p: dict[str, np.ndarray], classes: Classes, batch: int = 512, rate: float = 0.005, seed: int = 5) -> dict[str, np.ndarray]:
    """The parameters after every window of ``runs``, dealt by hash to as many groups, was taken once."""
    shared = runs.sparkSession.sparkContext.broadcast((p, classes))
    others, most, end = [k for k in p if k != "E"], 2 * GROUP_WINDOWS, len(p["E"]) - 1

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """All windows of the task; those of a group that came out too large, in pieces."""
        held, size = [], 0
        for b in batches:
            for w in b.column("w").to_pylist():
                held.append(w)
                size += -(-len(w) // (2 * STRIDE))
                if size >= most:
                    yield _unpacked(held, end)
                    held, size = [], 0
        if held:
            yield _unpacked(held, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, classes = shared.value
        part, windows_ = TaskContext.get().partitionId(), 0
        p, weight, random = {k: v.copy() for k, v in start.items()}, np.zeros(len(start["E"]), np.int64), np.random.default_rng([seed, part])
        for rows in chunks(batches):
            steps = -(-len(rows) // batch)
            _fit(p, classes, rows, iter(np.array_split(random.permutation(len(rows)), steps)), steps, rate)
            weight += np.bincount(rows[:, : 2 * STRIDE].ravel(), minlength=len(weight))
            windows_ += len(rows)
        if not windows_:
            return
        # Only the embeddings that the group moved are sent.
        used = np.flatnonzero(weight)
        cut = np.flatnonzero(np.concatenate([[True], used[1:] // BLOCK != used[:-1] // BLOCK]))
        out = [(-1, np.zeros(1, np.int32), np.full(1, float(windows_)), np.concatenate([p[k].ravel() for k in others]))]
        out += [(int(used[a] // BLOCK), (used[a:b] % BLOCK).astype(np.int32), weight[used[a:b]].astype(np.float64), p["E"][used[a:b]]) for a, b in zip(cut, np.append(cut[1:], len(used)), strict=True)]
        columns = [pa.array([r[0] for r in out], pa.int32()), pa.array([part] * len(out), pa.int32()), *(pa.array([r[c].tobytes() for r in out], pa.binary()) for c in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "part", "ids", "weight", "p"])

    def mean(t: pa.Table) -> pa.Table:
        t, block = t.sort_by("part"), t.column("block")[0].as_py()
        total = weights = None
        for ids, w, x in zip(*(t.column(c).to_pylist() for c in ("ids", "weight", "p")), strict=True):
            ids, w = np.frombuffer(ids, np.int32), np.frombuffer(w)
            x = np.frombuffer(x, np.float32).reshape(len(w), -1)
            if total is None:
                n = 1 if block < 0 else BLOCK
                total, weights = np.zeros((n, x.shape[1])), np.zeros(n)
            total[ids] += w[:, None] * x
            weights[ids] += w
        ids = np.flatnonzero(weights).astype(np.int32)
        columns = [ids, weights[ids], (total[ids] / weights[ids][:, None]).astype(np.float32)]
        return pa.table({"block": t.column("block").slice(0, 1), "part": pa.array([t.column("part")[0].as_py() // MEANS], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("ids", "weight", "p"), columns, strict=True)}})

    kind = "block int, part int, ids binary, weight binary, p binary"
    means = runs.repartition(groups, "k", "run").sortWithinPartitions("k", "run", "w").select("w").mapInArrow(run, kind)
    while groups > 1:  # no task reads the parameters of more than MEANS groups
        means, groups = means.groupBy("block", F.floor(F.col("part") / MEANS)).applyInArrow(mean, kind), -(-groups // MEANS)
    out = {k: v.copy() for k, v in p.items()}
    for r in means.groupBy("block").applyInArrow(mean, kind).collect():
        ids, value = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["p"], np.float32)
        if r["block"] < 0:
            for k, v in zip(others, np.split(value, np.cumsum([p[k].size for k in others])[:-1]), strict=True):
                out[k] = v.reshape(p[k].shape)
        else:
            out["E"][r["block"] * BLOCK + ids] = value.reshape(len(ids), -1)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """``h, n, subword``: how often each word occurs, by its hash, and each subword, by its id."""
    return _word_counts(tokenized(texts.select("text", F.lit(0).alias("doc_id"), F.lit(0).alias("k"), F.lit(True).alias("training")), path), path)


def _word_counts(pieces: DataFrame, path: str) -> DataFrame:
    shift = np.uint64(64 - (RANGES.bit_length() - 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[np.ndarray, np.ndarray]], subwords: np.ndarray) -> pa.RecordBatch:
            h, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([x for _, x in held]))
            cuts = np.searchsorted(h >> shift, np.arange(RANGES + 1).astype(np.uint64))
            rows = [(k, h[a:b].astype("<u8").tobytes(), n[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            used = np.flatnonzero(subwords)
            rows.append((RANGES, used.astype("<u8").tobytes(), subwords[used].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "h", "n"])

        end = _encoding(path)[1]
        held, size, subwords = [], 0, np.zeros(end + 1, np.int64)
        for batch in batches:
            for piece in _read(batch, end):
                h, lens, words = piece.words(path)
                word = np.repeat(piece.training, words)
                word[np.cumsum(words) - 1] = False  # the ends are counted as subwords only
                held.append(np.unique(h[word], return_counts=True))
                subwords += np.bincount(piece.learned()[0], minlength=len(subwords))
                size += int(words[piece.training].sum())
                if size > 1 << 22:
                    yield flush(held, subwords)
                    held, size, subwords = [], 0, np.zeros(end + 1, np.int64)
        if size:
            yield flush(held, subwords)

    def total(t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in t.column("h").to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("n").to_pylist()])
        h, inv = np.unique(h, return_inverse=True)
        return pa.table({"h": pa.array(h.view(np.int64)), "n": pa.array(np.bincount(inv, n, minlength=len(h)).astype(np.int64)), "subword": pa.array([t.column("range")[0].as_py() == RANGES] * len(h))})

    return pieces.drop("ids").mapInArrow(partial, "range int, h binary, n binary").groupBy("range").applyInArrow(total, "h long, n long, subword boolean")


class Lookup:
    """Counts of the frequent words by hash: a sorted table with a first place for each leading 20 bits."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        self.first = np.searchsorted(self.h >> np.uint64(44), np.arange((1 << 20) + 1).astype(np.uint64))
        self.most = int(np.diff(self.first).max()) if len(h) else 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The counts, 0 for a word that the table lacks."""
        out = np.zeros(len(h), np.int64)
        if len(self.h):
            at = self.first[(h >> np.uint64(44)).astype(np.int64)]
            for k in range(self.most):
                slot = np.minimum(at + k, len(self.h) - 1)
                hit = self.h[slot] == h
                out[hit] = self.n[slot[hit]]
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pa.array([np.asarray(c).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns]
        yield pa.RecordBatch.from_arrays(columns, ["h", "n"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, share: int = 1, steps: int = 400) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    pieces = common.staged(tokenized(rows.select("doc_id", key.alias("k"), (~held_out(F.col("doc_id"))).alias("training"), "text"), tokenizer), "subwords")
    both = common.staged(_word_counts(pieces, tokenizer), "words")
    counts = both.filter("NOT subword").select("h", "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = rows.filter(~held_out(F.col("doc_id"))).count()
    n_all, distinct = total["n"] + n_docs, total["v"] + (n_docs > 0)
    # The least count with which the words at or above it are within the bound.
    levels = {r["level"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("k")).collect()}
    least, room = 1 << 62, MAX_FREQUENT
    for level in sorted(levels, reverse=True):
        if (room := room - levels[level]) < 0:
            break
        least = 1 << level
    size = _encoding(tokenizer)[1] + 1
    subwords = np.zeros(size, np.int64)
    for r in both.filter("subword").collect():  # at most one row for each entry of the tokenizer
        subwords[r["h"]] = r["n"]
    seen = common.staged(_window_rows(pieces, share, subwords), "windows")
    contexts = np.zeros(len(_frequent(subwords)[1]) * (SINGLE + 1), np.int64)
    for r in seen.filter("i IS NOT NULL").groupBy("i").agg(F.sum("n").alias("n")).collect():
        contexts[r["i"]] = r["n"]
    runs, rng = seen.filter("i IS NULL").select("k", "run", "w"), np.random.default_rng(5)
    classes = _cluster(subwords, contexts, rng)
    p = _start(subwords, classes, rng)
    first = start_runs(runs).collect()
    if first:
        rows_ = _unpacked([bytes(r["w"]) for r in first], size - 1)
        _fit(p, classes, rows_, (rng.integers(0, len(rows_), 512) for _ in range(steps)), steps, 0.01)
    if n_docs:
        p = learned(runs, -(-(int(subwords.sum()) // (STRIDE * share) + n_docs) // GROUP_WINDOWS), p, classes)
    model = _model(tokenizer, p, classes)
    often = counts.filter(F.col("n") >= least).mapInArrow(_packed, "h binary, n binary").collect()
    shared = spark.sparkContext.broadcast((model, np.frombuffer(b"".join(bytes(r["h"]) for r in often), np.uint64), np.frombuffer(b"".join(bytes(r["n"]) for r in often), np.int64)))
    del often, model
    denominator, end_count = n_all + distinct + 1, n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, h, n = shared.value
        lookup = Lookup(h, n)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, piece in enumerate(_read(batch, model.n)):
                tokens, lengths = piece.tokens, piece.lengths
                words, lens, per_text = piece.words(model.path)
                begin = np.cumsum(per_text) - per_text
                by_word = np.add.reduceat(token_scores(model, tokens, lengths).astype(np.float64), np.cumsum(lens) - lens)
                c = lookup(words)
                c[begin + per_text - 1] = end_count
                found = c > 0
                found[begin + per_text - 1] = True  # the end is always counted here
                base = np.where(found, np.log10((c + 1) / denominator), 0.0)
                both = np.where(found, np.log10(MIX * (c + 1) / denominator + (1 - MIX) * np.exp(by_word)), 0.0)
                rest = np.flatnonzero(~found)
                of = np.searchsorted(begin, rest, "right") - 1
                cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(per_text)))]).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(words[rest].view(np.int64)), pa.array(by_word[rest])], ["h", "lp"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(per_text))), batch.column("ids")[k].values, pa.array(per_text),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(both, begin)),
                        pa.ListArray.from_arrays(pa.array(cuts), tail),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "base", "both", "tail"],
                )
                row += len(per_text)

    kind = dict(rows.dtypes)["doc_id"]
    scored = common.staged(pieces.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, both double, tail array<struct<h:bigint,lp:double>>"), "scores")
    # Words that did not travel: by a join with all counts.
    tail = scored.select("row", F.explode("tail").alias("x")).select("row", "x.h", "x.lp").join(counts, "h", "left")
    c = F.coalesce("n", F.lit(0))
    unigram = (c + 1) / float(denominator)
    rare = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, 1).otherwise(0)).alias("rare_known"), F.sum(F.log10(unigram)).alias("rare_base"), F.sum(F.log10(MIX * unigram + (1 - MIX) * F.exp("lp"))).alias("rare_both")
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.select("row", "doc_id", "n_tokens", "known", "base", "both").join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", add("known", "rare_known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        add("base", "rare_base").alias("base_score"), add("both", "rare_both").alias("score"),
    )
