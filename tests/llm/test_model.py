import math
import random

import numpy as np
import pytest
from util import LOWER, WORD, crc_mod, documents, odd_rows, prose

from tracemill.llm import lm_score


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(21)
    return lm_score.train([prose(rng, 200) for _ in range(60)], steps=60)


def test_probabilities(model):
    # Over all subwords the probabilities of the next one sum to one.
    rng = np.random.default_rng(1)
    context = rng.integers(0, model.n, 40)
    seqs = [np.append(context, y) for y in range(0, model.n + 1)]
    total = 0.0
    for k in range(0, len(seqs), 5000):
        part = seqs[k : k + 5000]
        p = lm_score.token_scores(model, np.concatenate(part), np.full(len(part), 41))
        total += np.exp(p.reshape(-1, 41)[:, -1].astype(np.float64)).sum()
    assert total == pytest.approx(1.0, rel=1e-3) and len(model.classes.members) > 20


def test_gradients():
    """The gradients are those of the summed log probability."""
    rng = np.random.default_rng(4)
    counts = rng.integers(5, 50, 200)
    tokens = rng.integers(0, 199, 300)
    classes = lm_score._cluster(counts, rng.integers(1, 9, (len(lm_score._frequent(counts)[1]), lm_score.SINGLE + 1)), rng)
    p = {k: v.astype(np.float64) for k, v in lm_score._start(counts, classes, rng).items()}
    rows, _ = lm_score.windows(tokens, np.array([200, 100]), 199)
    moved = {k: v.copy() for k, v in p.items()}
    loss = lambda q: -lm_score.token_scores(lm_score._model("", {k: v.astype(np.float32) for k, v in q.items()}, classes), tokens, np.array([200, 100])).mean()
    before = loss(p)
    for _ in range(30):
        lm_score._fit(moved, classes, rows, iter([np.arange(len(rows))]), 2, 0.01)
    assert loss(moved) < before - 0.1
    # A step of Adam moves a parameter against its gradient: compared with differences of the loss.
    once = {k: v.copy() for k, v in p.items()}
    lm_score._fit(once, classes, rows, iter([np.arange(len(rows))]), 2, 1e-3)
    for name in ("H", "G", "W", "w", "Q", "K", "V", "C", "A"):
        right = tried = 0
        for at in rng.permutation(p[name].size)[:12]:
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name].flat[at] += 0.05
            down[name].flat[at] -= 0.05
            slope = float(loss(up) - loss(down))
            if abs(slope) > 2e-5:
                tried += 1
                right += np.sign(slope) == -np.sign(once[name].flat[at] - p[name].flat[at])
        assert right >= 0.8 * tried, name


def test_scores_are_causal_and_per_text(model):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, model.n, 90), rng.integers(0, model.n, 33)
    alone = lm_score.token_scores(model, a, np.array([90]))
    beside = lm_score.token_scores(model, np.concatenate([b, a]), np.array([33, 90]))
    assert np.allclose(alone, beside[33:], atol=1e-4)
    changed = a.copy()
    changed[60:] = 5
    assert np.allclose(lm_score.token_scores(model, changed, np.array([90]))[:60], alone[:60], atol=1e-4)


def test_training_helps():
    rng = random.Random(22)
    texts, other = [prose(rng, 200) for _ in range(80)], [prose(rng, 200) for _ in range(20)]

    def mean(steps, attention=True):
        m = lm_score.train(texts, steps=steps, attention=attention)
        words = lm_score.Words(m.path)
        import pyarrow as pa

        from tracemill.llm import textcodes

        scores = []
        for _, _, data, offsets in textcodes.pieces(pa.array(other)):
            t, lens, per_text, _, _ = words.subwords(data, offsets)
            scores.append(lm_score.token_scores(m, t, np.add.reduceat(lens, np.cumsum(per_text) - per_text)))
        return float(np.concatenate(scores).mean())

    assert mean(200) > mean(0) + 0.2


def test_attention_gains_over_its_ablation():
    """Texts whose words depend on one several words back: only attention sees it."""
    rng = random.Random(31)

    def text():
        kind = rng.choice([("alpha", ("red", "green", "blue")), ("beta", ("one", "two", "three"))])
        return " ".join(" ".join([kind[0], *(rng.choice(("and", "or", "but")) for _ in range(2)), rng.choice(kind[1])]) for _ in range(30))

    texts, other = [text() for _ in range(150)], [text() for _ in range(30)]
    import pyarrow as pa

    def mean(attention):
        m = lm_score.train(texts, steps=300, attention=attention)
        t, _, lengths = next(lm_score._sequences(pa.array(other), lm_score.Words(m.path)))
        return float(lm_score.token_scores(m, t, lengths).mean())

    assert mean(True) > mean(False) + 0.05


@pytest.mark.parametrize("most", [None, 0])
def test_score(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(lm_score, "MAX_FREQUENT", most)  # every word by the join
    rng = random.Random(23)
    rows = [r[:2] for r in odd_rows()] + [(1000 + k, prose(rng, rng.randint(1, 120))) for k in range(250)]
    got = lm_score.score(documents(spark, rows).repartition(4), steps=80).collect()
    counts = {}
    for d, t in rows:
        if not crc_mod(d):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, crc_mod(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n) for d, t in rows), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    base = sorted(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)) for _, t in rows)
    assert sorted(r["base_score"] for r in got) == pytest.approx(base, rel=1e-9)
    assert all(r["score"] < 0 for r in got)
    fours = [r["score"] for r in got if r["doc_id"] == 4]
    assert fours[0] == pytest.approx(fours[1]) and fours[0] == pytest.approx(next(r["score"] for r in got if r["doc_id"] == 3))
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) - 0.31 * sum(r["n_tokens"] for r in held)


def test_model_learns_from_all_texts(spark, monkeypatch):
    """Also without a start, whatever the groups and the layout of the rows."""
    rng = random.Random(24)
    rows = [(k, prose(rng, 400)) for k in range(300)]
    monkeypatch.setattr(lm_score, "GROUP_WINDOWS", 5000)
    monkeypatch.setattr(lm_score, "START_ROWS", 0)
    got, again = (sorted(lm_score.score(documents(spark, rows).repartition(n), share=1).collect()) for n in (3, 5))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) - 0.25 * sum(r["n_tokens"] for r in held)
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in again], rel=1e-4)


def test_windows_of_texts_of_any_length(spark):
    """Every text gives its share, long ones too, and the runs hold what the windows of the text are."""
    rng = random.Random(25)
    texts = [prose(rng, 30_000), prose(rng, 300), "one", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    words = lm_score.Words(lm_score.TOKENIZER)
    import pyarrow as pa

    tokens, inputs = (np.concatenate(x) for x in list(zip(*lm_score._sequences(pa.array(texts), words), strict=True))[:2])
    counts = np.bincount(tokens, minlength=words.end + 1)
    expect = lm_score._contexts(counts, tokens, inputs)
    sums = {(r["h"]): r["n"] for r in lm_score.word_counts(df.select("text").repartition(3), lm_score.TOKENIZER).collect() if r["subword"]}
    assert sums == {int(k): int(counts[k]) for k in np.flatnonzero(counts)}
    for share in (1, 8):
        got = {}
        rows, contexts = lm_score.window_rows(df.repartition(3), lm_score.TOKENIZER, share, counts), np.zeros(len(expect), int)
        for r in rows.collect():
            if r["i"] is not None:
                contexts[r["i"]] += r["n"]
                continue
            got.setdefault(r["k"], []).append((r["run"], lm_score._unpacked([bytes(r["w"])])))
        for k, t in enumerate(texts):
            tokens, _, lengths = next(lm_score._sequences(pa.array([t]), words))
            rows, _ = lm_score.windows(tokens, lengths, words.end)
            want = rows[(np.arange(len(rows)) + k) % share == 0]
            found = np.concatenate([x for _, x in sorted(got.get(k, []), key=lambda x: x[0])] or [rows[:0]])
            assert (found == want).all() and len(found) == len(want)
        assert (contexts == expect).all()


def test_score_without_training_texts(spark):
    assert lm_score.score(documents(spark, [(1, "x")]).limit(0), steps=5).count() == 0
    held = next(k for k in range(100) if crc_mod(k))
    r = lm_score.score(documents(spark, [(held, "some words")]), steps=5).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0.0 and r["held_out"]


def test_score_learns_from_every_window(spark, monkeypatch):
    """By default the weights take each position of each training text once."""
    import pyarrow as pa

    rng = random.Random(26)
    rows = [(k, prose(rng, n)) for k, n in enumerate([5000, 400, 17, 1, 0, 90, 1200, 33, 64, 250])]
    taken = []

    def learned(runs, groups, p, *rest):
        taken.append((lm_score._unpacked([bytes(r["w"]) for r in runs.select("w").collect()]), groups))
        return p

    monkeypatch.setattr(lm_score, "learned", learned)
    lm_score.score(documents(spark, rows).repartition(3), steps=2).count()
    words, want = lm_score.Words(lm_score.TOKENIZER), []
    for k, t in rows:
        if not crc_mod(k):
            tokens, _, lengths = next(lm_score._sequences(pa.array([t]), words))
            want.append(lm_score.windows(tokens, lengths, words.end)[0])
    want = np.concatenate(want)
    (got, groups), = taken
    assert got.shape == want.shape and groups == 1
    assert (np.unique(got, axis=0) == np.unique(want, axis=0)).all()
    assert sorted(map(bytes, got)) == sorted(map(bytes, want))


def test_packed_runs_of_wide_subwords():
    rng = np.random.default_rng(7)
    lengths, end = np.array([1, 16, 17, 3000, 33]), 70_000
    tokens = rng.integers(0, end, lengths.sum())
    tokens[np.cumsum(lengths) - 1] = end
    text, first = lm_score._windows(lengths)
    number = first // lm_score.STRIDE
    begin = np.flatnonzero(number % lm_score.RUN == 0)
    last = np.minimum(number[begin] + lm_score.RUN, -(-lengths[text[begin]] // lm_score.STRIDE))
    packed = lm_score._packed_runs(tokens, lengths, end, text[begin], number[begin], last).to_pylist()
    alone = np.concatenate([lm_score.windows(t, np.array([len(t)]), end)[0] for t in np.split(tokens, np.cumsum(lengths)[:-1])])
    assert (lm_score._unpacked(packed, end) == alone).all() and len(packed) == 7


def test_parameters_of_many_groups_are_averaged(spark, monkeypatch):
    """The average does not depend on how many groups are averaged at a time, and a group that is too large is taken in pieces."""
    rng = random.Random(27)
    rows = [(k, prose(rng, 300)) for k in range(120)]
    monkeypatch.setattr(lm_score, "GROUP_WINDOWS", 400)
    got = []
    for means in (64, 2):
        monkeypatch.setattr(lm_score, "MEANS", means)
        got.append([r["score"] for r in sorted(lm_score.score(documents(spark, rows), steps=5).collect())])
    assert got[0] == pytest.approx(got[1], rel=1e-4)


def test_start_runs(spark, monkeypatch):
    """As many runs as wanted, whatever the layout, and few more are looked at."""
    monkeypatch.setattr(lm_score, "START_ROWS", 50)
    runs = spark.range(3000).selectExpr("id AS k", "0L AS run", "CAST(CAST(id AS STRING) AS BINARY) AS w")
    got, again = ([bytes(r["w"]) for r in lm_score.start_runs(runs.repartition(n)).collect()] for n in (2, 7))
    assert got == again and len(set(got)) == 50
    assert lm_score.start_runs(runs.limit(60)).count() == 50 and lm_score.start_runs(runs.limit(9)).count() == 9


def test_clusters_are_of_equal_size():
    """Also where most subwords follow the same ones, so that no cluster costs much more than the others."""
    rng = np.random.default_rng(8)
    counts = rng.integers(5, 500, 900)
    often = lm_score._frequent(counts)[1]
    contexts = rng.integers(1, 4, (len(often), lm_score.SINGLE + 1))
    contexts[: len(often) // 2, 0] += 1000
    classes = lm_score._cluster(counts, contexts, rng)
    sizes = np.bincount(classes.group[often] - lm_score.SINGLE, minlength=lm_score.CLUSTERS)[:-1]
    assert sizes.sum() == len(often) and sizes.max() <= -(-len(often) // (lm_score.CLUSTERS - 1))
    assert (classes.members[classes.cut[classes.group[often] - lm_score.SINGLE] + classes.slot[often]] == often).all()


def test_pieces_tell_words_apart_as_their_bytes_do(spark):
    """Texts are read for their subwords once; what is kept has the same words, also those that are no valid UTF-8."""
    import pyarrow as pa

    from tracemill.llm import textcodes

    texts = [b"one Two \xff one", b"", b"\xff \xfe two \xef\xbf\xbd \xff\xfe", b" " + b"x" * 300 + "ü ü".encode(), b"One \xfe"]
    data, offsets = textcodes.string_buffer(pa.array(texts, pa.binary()))
    words = lm_score.Words(lm_score.TOKENIZER)
    tokens, lens, per_text, _, seq = words.subwords(data, offsets)
    lengths = np.add.reduceat(lens, np.cumsum(per_text) - per_text)
    piece = lm_score.Piece(np.arange(5), np.ones(5, bool), tokens, lengths, *lm_score._odd(data, offsets))
    h, found, n = piece.words(lm_score.TOKENIZER)
    assert (found == lens).all() and (n == per_text).all()
    assert (np.unique(h, return_inverse=True)[1][:, None] == np.unique(h, return_inverse=True)[1]).tolist() == (seq[:, None] == seq).tolist()
    df = spark.createDataFrame([(k, "a b c " * k) for k in range(9)], "doc_id long, text string").selectExpr("doc_id", "doc_id AS k", "doc_id % 2 = 0 AS training", "text")
    got = {}
    for b in lm_score.tokenized(df.repartition(3), lm_score.TOKENIZER).toArrow().to_batches():
        for k, p in enumerate(lm_score._read(b, words.end)):
            got |= dict(zip(b.column("ids")[k].as_py(), zip(p.lengths.tolist(), p.training.tolist(), strict=True), strict=True))
    assert got == {k: (3 * k + 1, k % 2 == 0) for k in range(9)}
