import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import LOWER, WORD, documents, odd_rows, prose

from tracemill.llm import decontaminate, graph, line_dedup, ngram_join, queries, suffix_dedup, textcodes

SMALL = "/root/testdata/sf0.001"


def removed(texts, length=200):
    """What the substring rule leaves of each text."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            x = b[i : i + length]
            count[x] = count.get(x, 0) + 1
    out = []
    for b in raw:
        runs = []
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        kept, at = b"", 0
        for x, y in runs:
            kept += b[at:x]
            at = y
        out.append((len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


def dedup(df):
    return df.select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n_spans"), "kept_sha256").collect()


def test_suffix_dedup(spark):
    rng = random.Random(11)
    passage = [prose(rng, 70) for _ in range(5)]
    rows = [r[:2] for r in odd_rows() if r[0] != 5] + [(50, "ab " * 400), (51, "a" * 900), (52, "a" * 199), (53, "a" * 200 + "b"), (54, "xy" * 150 + "é" * 120)]
    for k in range(120):
        parts = [prose(rng, rng.randint(5, 60)), rng.choice(passage), prose(rng, rng.randint(0, 30))]
        text = " ".join(parts[: rng.randint(1, 3)])
        if rng.random() < 0.3:
            text += text[rng.randint(0, len(text) - 1) :]
        rows.append((100 + k, text))
    rows += [(300 + k, rows[60][1]) for k in range(4)]
    got = sorted(map(tuple, dedup(suffix_dedup.substring_dedup(documents(spark, rows).repartition(6)))), key=str)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows]), strict=True)), key=str)
    assert dedup(suffix_dedup.substring_dedup(documents(spark, rows).limit(0))) == []


def test_suffix_dedup_long_text(spark):
    rng = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyz     "
    long_ = "".join(rng.choices(alphabet, k=textcodes.PIECE + 300_000))
    at = textcodes.PIECE - 150
    rows = [(1, long_), (2, "start " + long_[at : at + 400] + " end"), (3, long_[1000:1250] + long_[900_000:900_199])]
    got = sorted(map(tuple, dedup(suffix_dedup.substring_dedup(documents(spark, rows)))))
    assert [g[1:4] for g in got] == [(len(long_), 650, 2), (410, 400, 1), (449, 250, 1)]


def test_suffix_dedup_repeat_across_parts(spark):
    rng = random.Random(14)
    passage, *own = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=k)) for k in (260, 10_000, 2_000_000, 400_000))
    edge = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=textcodes.PIECE + 5000))  # runs cross the parts, nothing repeats
    rows = [(1, own[0] + passage + own[1] + "#" + passage + own[2]), (2, edge)]
    got = sorted(suffix_dedup.substring_dedup(documents(spark, rows)).collect())
    spans = [(x["start"], x["end"]) for x in got[0]["removed"]]
    second = 10_000 + 260 + 2_000_000 + 1
    assert all(a <= at and at + 260 <= b and b - a <= 264 for (a, b), at in zip(spans, (10_000, second), strict=True))
    assert got[1]["n_removed"] == 0


def test_blind_trie_and_deep_shallow():
    rng = random.Random(13)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)})
    rng.shuffle(strings)
    assert [strings[i] for i in suffix_dedup.blind_trie_order(strings)] == sorted(strings)
    common = b"x" * 90
    rows = [(g, common[: rng.choice([10, 70, 90])].ljust(90, b"y") + bytes(rng.choice(b"ab") for _ in range(10))) for g in range(20) for _ in range(rng.randint(1, 12))]
    group = np.array([g for g, _ in rows])
    order, lcp = suffix_dedup.deep_shallow([s for _, s in rows], group)
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for k in range(1, len(got)):
        if got[k][0] == got[k - 1][0]:
            a, b = got[k][1], got[k - 1][1]
            assert lcp[k] == next((i for i in range(100) if a[i] != b[i]), 100)
        else:
            assert lcp[k] == -1


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def linked(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width, percent, block", [(4, 85, 2000), (5, 80, 2000), (4, 85, 25)])
def test_similarity_join(spark, width, percent, block):
    rng = random.Random(14)
    rows = [r[:2] for r in odd_rows() if r[0] != 5]
    base = prose(rng, 150).split()
    rows += [(None, " ".join([*base[:149], f"near{k % 3}"])) for k in range(5)]  # null ids that link with others, some twice
    bridge = prose(rng, 200).split()  # two documents that only a row without an id joins
    rows += [(3500, " ".join(bridge)), (None, " ".join([*bridge[:197], "x", "y", "z"])), (3501, " ".join(["p", "q", "r", "s", "t", *bridge[5:195], "u", "v", "x", "y", "z"]))]
    for k in range(140):  # more near copies than make a token frequent
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(60):
        text = prose(rng, rng.randint(1, 80))
        rows.append((2000 + 2 * k, text))
        rows.append((2001 + 2 * k, text.upper() if k % 3 else text + " more words here"))
    passage = prose(rng, 40)
    rows += [(3000 + k, prose(rng, 100) + " " + passage) for k in range(80)]
    got = ngram_join.similarity_join(documents(spark, rows).repartition(5), width=width, percent=percent, block=block).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows, width, percent)


def test_similarity_join_full_table(spark, monkeypatch):
    """Frequent tokens that find no place in the bounded table lose no link."""
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    rng = random.Random(5)
    rows = [(500 + k, prose(rng, 70)) for k in range(20)]
    for g in range(2):
        base = prose(rng, 90).split()
        for k in range(30):
            ws = list(base)
            ws[rng.randrange(90)] = f"other{g}{k}"
            rows.append((100 * g + k, " ".join(ws)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_join(documents(spark, rows), width=4, percent=85).collect()}
    expect = {r[0]: r[2] for r in linked(rows, 4, 85)}
    assert got == expect and len(set(expect.values())) < 30


def test_similarity_join_empty(spark):
    assert ngram_join.similarity_join(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.similarity_join(documents(spark, [(1, None)])).collect()] == [(1, 0, 1, 0)]
    with pytest.raises(ValueError):
        ngram_join.similarity_join(documents(spark, [(1, "x")]), percent=0)


@pytest.mark.parametrize("percent", [10, 30, 55])
def test_similarity_join_at_low_thresholds(spark, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for k in range(90)]
    got = ngram_join.similarity_join(documents(spark, rows), width=1, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows, 1, percent)
    pair = [(1, "a b c d e f"), (2, "f g h i j k")]
    assert [r["n_links"] for r in ngram_join.similarity_join(documents(spark, pair), width=1, percent=9).collect()] == [1, 1]


def test_similarity_join_long_texts(spark):
    """A group of long near copies: all shingles are frequent, yet the combinations stay about as many as they are."""
    rng = random.Random(22)
    base = prose(rng, 20_000).split()
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(60 * (k % 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((k, " ".join(w[k * 4 :])))
    got = ngram_join.similarity_join(documents(spark, rows), block_shingles=300_000).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows, 4, 85)
    top = np.sort(np.random.default_rng(1).integers(0, 1 << 63, ngram_join._prefix(20_000, 85)).astype(np.uint64))
    assert len(ngram_join.combinations(top, 20_000, 85)) < 40_000


def test_combinations_of_linked_texts_meet():
    rng = np.random.default_rng(3)
    for percent in (10, 50, 85, 100):
        for n in (1, 2, 3, 10, 49, 50, 99, 100, 350, 351, 1200):
            m = int(rng.integers(-(-n * percent // 100), n + 1))  # a partner's size
            k = ngram_join._shared(m, percent)
            tokens = rng.integers(0, 1 << 63, 3 * n + 3).astype(np.uint64)
            both = tokens[:k]
            a = np.concatenate([both, tokens[k : k + max(0, ngram_join._prefix(n, percent) - k)]])
            b = np.concatenate([both, tokens[2 * n : 2 * n + max(0, ngram_join._prefix(m, percent) - k)]])
            assert set(ngram_join.combinations(a, n, percent).tolist()) & set(ngram_join.combinations(b, m, percent).tolist()), (percent, n, m)


def test_join_spread(spark):
    from tracemill.llm import common

    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 1).otherwise(F.col("id")).alias("g"), "id")
    table = rows.groupBy("g").agg(F.count("*").alias("k"))
    got = common.join_spread(rows, table, "g", F.col("id"))
    assert got.select("g", "id").exceptAll(rows).count() == 0 and got.count() == 20_000 and got.columns == ["g", "id", "k"]


def test_components(spark):
    rng = random.Random(15)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(500, k) for k in range(501, 700)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def distance(item, text):
    """Edits of the best match of the item within the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def normal(text):
    return " ".join((text or "").lower().split())


def test_decontamination(spark):
    rng = random.Random(16)
    items = [(k, prose(rng, rng.randint(9, 40), lines=k % 2 == 0).capitalize()) for k in range(12)] + [(20, "short"), (21, None), (22, ""), (23, None)]
    items.append((24, items[3][1]))
    rows = [r[:2] for r in odd_rows() if r[0] != 5]
    for k in range(90):
        i, item = items[rng.randrange(12)]
        chars = list(item)
        for _ in range(rng.randint(0, int(0.12 * len(chars)))):
            p = rng.randrange(len(chars))
            chars[p : p + 1] = rng.choice([["q"], [], [chars[p], "z"]])
        rows.append((100 + k, prose(rng, rng.randint(0, 40)) + " " + ("".join(chars) if k % 3 else "") + " " + prose(rng, rng.randint(0, 40))))
    docs, bench = documents(spark, rows), spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.find_contamination(docs, bench).collect()
    want = set()
    for n, (d, t) in enumerate(rows):
        for i, item in items:
            m = normal(item)
            if len(m) >= 32 and distance(m, normal(t)) <= int(0.08 * len(m)):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 40
    texts = dict(rows)
    for r in got:
        m = normal(dict(items)[r["item_id"]])
        part = normal(texts[r["doc_id"]][r["start"] : r["end"]])
        assert distance(m, part) <= r["edits"] + 2 and abs(len(part) - len(m)) <= int(0.08 * len(m)) + 1
    blocks = decontaminate.find_contamination(docs, bench, block_chars=200).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in blocks) == sorted((str(r["doc_id"]), r["item_id"]) for r in got)
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_long_text(spark, monkeypatch):
    rng = random.Random(17)
    item = prose(rng, 30)
    text = prose(rng, 3000)
    monkeypatch.setattr(decontaminate, "PART", 6000)
    index = decontaminate.Index([(1, item)], 0.08, 32)
    places = [5900, 11_000]
    for at in places:
        text = text[:at] + " " + item + " " + text[at:]
    found = list(decontaminate.match_texts(index, [9], [text]))
    assert {(f[2], f[4]) for f in found} >= {(text.find(item), 0), (text.rfind(item), 0)}


def test_decontamination_item_longer_than_a_part(monkeypatch):
    rng = random.Random(26)
    item = prose(rng, 200)
    text = prose(rng, 2000) + " " + item + " " + prose(rng, 2000)
    monkeypatch.setattr(decontaminate, "PART", len(item) // 2)
    found = list(decontaminate.match_texts(decontaminate.Index([(1, item)], 0.08, 32), [9], [text]))
    assert (text.find(item), 0) in {(f[2], f[4]) for f in found}


def test_patience():
    rng = random.Random(18)
    for _ in range(300):
        a, b = ([rng.randint(1, 12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 9, 4]) == [(0, 0), (1, 1), (3, 3)]
    assert line_dedup._increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (4, 4)], [(1, 1), (2, 2), (3, 5)])


def test_line_dedup(spark):
    rng = random.Random(19)
    block = prose(rng, 60, lines=True)
    license_ = "Licensed under the same terms"
    rows = [r[:2] for r in odd_rows() if r[0] != 5]
    rows += [(100 + k, prose(rng, 30, lines=True) + "\n" + (block + f"\nown line {k}\n" if k % 2 else "") + license_ + "\n" + prose(rng, 30, lines=True)) for k in range(30)]
    copy = rows[-1][1]
    rows += [(500, copy), (501, copy)]
    docs = documents(spark, rows)
    got = sorted(line_dedup.line_dedup(docs).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for d, t in rows:
        if d is not None and d >= 100:
            n = len(block.split("\n"))
            expect = len(t.split("\n")) if d >= 500 else n if d % 2 and d > 101 else 0
            assert by[d]["n_removed"] == expect, d
            assert by[d]["n_lines"] == len(t.split("\n"))
    assert by[103]["text"].split("\n").count(license_) == 1 and block not in by[103]["text"] and block in by[101]["text"]
    # Of equal texts the first keeps its lines; a null id comes first.
    assert by[3]["n_removed"] == by[4]["n_removed"] == by[3]["n_lines"] and by[None]["n_removed"] == 0
    assert len(got) == len(rows) and by[0]["text"] == "" and by[0]["n_lines"] == 1
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_block_with_frequent_line(spark):
    """A block counts whole, also where one of its lines is frequent and first stands in another document."""
    often, few = "frequent line of forty characters or so..", "a line that only two of all documents hold, and which alone is too short"
    rows = [(k, f"own line {k}\n{often}\nlast line {k}") for k in range(6)]
    rows += [(k, f"start of {k}\n{often}\n{few}\nend of {k}") for k in (10, 11)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert len(few) < 100 <= len(often) + len(few)
    assert got[11] == "start of 11\nend of 11" and all(got[d] == t for d, t in rows if d != 11)


def test_patience_without_unique_lines():
    rng = random.Random(21)
    for _ in range(300):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        sizes = [10 * x for x in b]
        chars = [sum(sizes[:j]) for j in range(len(b) + 1)]
        i, j, n = line_dedup._heaviest(a, b, chars, 0, len(a), 0, len(b))
        common = [sum(sizes[y : y + m]) for x in range(len(a)) for y in range(len(b)) for m in range(1, len(b) - y + 1) if a[x : x + m] == b[y : y + m]]
        assert a[i : i + n] == b[j : j + n] and sum(sizes[j : j + n]) == max(common, default=0)
    p = [7, 8, 9]
    assert line_dedup.patience([1, *p, 2, *p, 3], [4, *p, 5]) in ([(1, 1), (2, 2), (3, 3)], [(5, 1), (6, 2), (7, 3)])
    assert line_dedup.common_blocks([1, *p, 2], [4, *p, 5, *p, 6], [40] * 9, 100) in ([1, 2, 3], [5, 6, 7])
    assert line_dedup.common_blocks([1, *p, 2], [4, *p, 5, *p, 6], [30] * 9, 100) == []


def test_line_dedup_passage_of_frequent_lines(spark):
    """Documents meet by a passage whose lines all are frequent and first stand elsewhere, each alone."""
    passage = [f"line {k} of a passage, some forty characters" for k in range(4)]
    rows = [(k, f"own line {k}\n{passage[k % 4]}\nlast line {k}") for k in range(20)]
    rows += [(100 + k, "\n".join([f"start of {k}", *passage[:2], "", *passage[2:], f"end of {k}"])) for k in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert all(got[d] == t for d, t in rows if d <= 100)
    assert all(got[100 + k] == f"start of {k}\nend of {k}" for k in range(1, 8))


def test_line_runs():
    rng = random.Random(20)
    docs = [[(x := rng.randint(0, 3), x * 20) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    flat = [x for d in docs for x in d]
    lines, sizes = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = {}
    for d, h in zip(*line_dedup.line_runs(lines, sizes, offsets, 100), strict=True):
        found.setdefault(int(d), set()).add(int(h))
    names = {}
    for d, doc in enumerate(docs):
        expect = set()
        for i, (x, _) in enumerate(doc):
            on = next((j for j in range(i + 1, len(doc) + 1) if sum(y[1] for y in doc[i:j]) >= 100), None)
            back = next((j for j in range(i, -1, -1) if sum(y[1] for y in doc[j : i + 1]) >= 100), None)
            expect |= {tuple(y[0] for y in doc[i:on])} if x and on is not None else set()
            expect |= {tuple(y[0] for y in doc[back : i + 1])} if x and back is not None else set()
        assert len(found.get(d, ())) == len(expect)
        for run in expect:
            names.setdefault(run, []).append(d)
    # Equal runs have one hash in all their documents.
    assert all(set.intersection(*(found[d] for d in ds)) for ds in names.values()) and len(names) == len(set().union(*found.values()))


def test_registered_queries_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op4_suffix_dedup(spark, SMALL).collect()))
    assert got == sorted((d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows]), strict=True))
    assert sorted(map(tuple, queries.op8_ngram_join(spark, SMALL).collect()), key=str) == linked(rows, 4, 85)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, SMALL).collect()}
    assert {(d, i) for d, t in rows for i, x in items if normal(x) in normal(t)} <= found


def line_removal(rows, min_chars=100):
    """Aligns every document with every earlier one."""
    import xxhash

    keep = lambda x: xxhash.xxh64_intdigest(x.encode()) if WORD.search(x) else 0
    docs = sorted({(d if d is not None else -1, t or "") for d, t in rows})
    lines = [[keep(x) for x in t.split("\n")] for _, t in docs]
    out = {}
    for j, (d, t) in enumerate(docs):
        sizes = [len(x) if WORD.search(x) else 0 for x in t.split("\n")]
        gone = set()
        for i in range(j):
            gone |= set(line_dedup.common_blocks(lines[i], lines[j], sizes, min_chars))
        out[d, t] = gone
    return out


def test_line_dedup_against_all_pairs(spark):
    """Every line that aligning all pairs removes is removed."""
    rng = random.Random(51)
    passages = [prose(rng, 60, lines=True) for _ in range(6)]
    common = [prose(rng, 9) for _ in range(4)]
    rows = [(k, passages[0].split("\n")[k % 6] + "\n" + prose(rng, 40, lines=True)) for k in range(6)]
    for k in range(6, 90):
        parts = [prose(rng, 30, lines=True), rng.choice(passages), rng.choice(common), prose(rng, 20, lines=True)]
        rows.append((k, "\n".join(parts[rng.randint(0, 1) :])))
    rows += [(200 + k, rows[20 + k][1]) for k in range(5)]
    want = line_removal(rows)
    keys = {(r["doc_id"], r["text"]): r for r in documents(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    got = {(r["key"]["doc_id"], r["key"]["hash"]): set(r["removed"]) for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    lost = total = 0
    for key, gone in want.items():
        found = got.get((key[0], keys[key]["h"]), set())
        assert found <= gone
        lost, total = lost + len(gone - found), total + len(gone)
    assert total > 300 and lost == 0
