import hashlib
import json
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from util import WORD, documents, odd_rows, prose

from tracemill.llm import chat_format, mixing, quality, secrets, sharding


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, words string, turns string, formatted string") if rows and len(rows[0]) == 7 else spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


HOSTILE = ["\\", "\\\\", "###", "####", "######", "</turn>", "<next/>", "\\h", "\\t", "\\x", "<", "</tur", "n>", "\n", "### assistant:\n", "### user:\n\\", "", " ", "é一", "\\### Assistant: </turn> ok", "$1", ".*"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "Odd:\nrole", "User"]), "".join(rng.choice(HOSTILE) for _ in range(rng.randint(0, 7)))))
    rng.shuffle(rows)
    out = chat_format.format_chats(chats(spark, rows))
    read = chat_format.parse_chats(out).withColumn("learned", chat_format.learned_text(out)).collect()
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    assert len(read) == 150
    for r in read:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["learned"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        # Control strings stand only where the template puts them.
        assert r["formatted"].count("</turn>") == sum(1 for a, b in zip([(None, 0), *want[r["conv_id"]]], want[r["conv_id"]], strict=False) if a[0] != b[0])


def test_chat_odd_rows(spark):
    rows = [(1, None, "user", "first", "x", "x", "x"), (1, 0, None, None, "x", "x", "x"), (1, 0, "assistant", "b", "x", "x", "x"), (1, 0, "assistant", "b", "x", "x", "x"), (None, 0, "assistant", "", "x", "x", "x"), (2, 5, "assistant", "z" * 200_000, "x", "x", "x")]
    got = {r["conv_id"]: r for r in chat_format.parse_chats(chat_format.format_chats(chats(spark, rows))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", "")]
    assert got[2]["loss"][0]["length"] == 200_000
    assert got[1]["formatted"].count("### assistant:") == 1  # equal roles are one block
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality_base(spark):
    rng = random.Random(3)
    rows = odd_rows() + [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))) for k in range(40)] + [(200, "x #$ | <a> %%% & **\nx #$ | <a> %%% & **\n"), (201, prose(rng, 50) + " " + " ".join(["a b c d e"] * 3))]
    got = quality.quality_rules(documents(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((d, *base(t)) for d, t, *_ in rows), key=key)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_verdict(spark):
    rng = random.Random(4)
    clean = [(k, prose(rng, 200, lines=True)) for k in range(60)]
    junk = [(1000, " ".join(w + "$$$###" for w in prose(rng, 150).split())), (1001, " | ".join("".join(rng.choice(["ka", "to", "ri", "mu"]) for _ in range(4)) for _ in range(150)))]
    short = [(2000, "$$$ ### " * 6)]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(spark, clean + junk + short)).collect()}
    assert all(got[d]["kept"] for d, _ in clean)
    assert not got[1000]["kept"] and not got[1001]["kept"]
    assert got[2000]["js_chars"] is None  # too short to be compared


def test_js_distance(spark):
    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))

    for p, q in (([1, 2, 3], [3, 2, 1]), ([1, 0, 0], [0, 1, 5]), ([4, 4, 4], [1, 1, 1])):
        r = spark.createDataFrame([(p, q)], "p array<bigint>, q array<bigint>").select(quality.js_distance(F.col("p"), F.col("q")).alias("x")).first()["x"]
        assert r == pytest.approx(js(p, q), abs=1e-9)


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        w = sum(weight[s] for s in rest)
        out = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in rest if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing(spark):
    rng = random.Random(5)
    rows = odd_rows() + [(1000 + k, prose(rng, rng.randint(0, 90)), "en", rng.choice(["a", "b", "b", "b", "c", "d", "Z", None, "é"])) for k in range(700)] + [(5000, None, "en", "nothing")]
    docs = documents(spark, rows)
    weights = spark.createDataFrame([(1000 + k, 2.0) for k in range(0, 700, 3)], "doc_id long, weight double")
    got = mixing.mix(docs, weights).collect()
    source = {}
    by_source = {}
    for d, t, *more in rows:
        s = more[1] if more else "s0"
        source[d] = s
        by_source[s] = by_source.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(by_source)
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        s = None if r["doc_id"] is None else source[r["doc_id"]]
        if r["doc_id"] is None:
            s = "s0"
        assert r["source_size"] == by_source[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(docs.repartition(7), weights).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Heavier documents come first: more of them are in the part that is not a whole epoch.
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_prefers_weight(spark):
    docs = documents(spark, [(k, "w " * 10, "en", "a" if k < 1000 else "b") for k in range(2000)])
    weights = spark.createDataFrame([(k, 4.0 if k % 2 else 0.25) for k in range(2000)], "doc_id long, weight double")
    got = [r for r in mixing.mix(docs, weights).collect() if r["doc_id"] < 1000 and r["taken"]]
    # Two thirds of the source are taken: nearly all of the heavy half, and few of the others.
    assert len(got) == 667 and sum(r["doc_id"] % 2 for r in got) > 0.95 * 500


@pytest.mark.parametrize("hot", [0, 2000])
def test_sharding(spark, hot):
    rng = random.Random(6)
    rows = odd_rows() + [(100 + k, prose(rng, rng.randint(1, 60))) for k in range(1500)] + [(10_000 + k, "the same text") for k in range(hot)]
    docs = documents(spark, rows)
    got = sharding.shard(docs, shards=40, ranges=64).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(40)) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    for s, rs in by.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    # Without a record that is larger than a shard's share, sizes differ by about a record.
    even = {}
    for r in sharding.shard(docs.filter("n_chars < 50000"), shards=40, ranges=64).collect():
        even.setdefault(r["shard"], []).append(r["size"])
    sums = [sum(x) for x in even.values()]
    assert len(even) == 40 and max(sums) - min(sums) <= 2 * max(max(x) for x in even.values())
    again = sharding.shard(docs.repartition(5), shards=40, ranges=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_of_one_row_repeated(spark, doc_id):
    """A row that makes up a third of all rows keeps the law, with gapless slots and equal reruns."""
    rng = random.Random(61)
    text = prose(rng, 30)
    rows = [(100 + k, prose(rng, rng.randint(20, 40))) for k in range(1600)] + [(doc_id, text)] * 800 + [(9, text)] * 3
    docs = documents(spark, rows)
    got = sharding.shard(docs.repartition(6), shards=40, ranges=64).collect()
    assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in got) == sorted((str(d), zlib.crc32(t.encode())) for d, t in rows)
    of = [[r for r in got if r["shard"] == s] for s in range(40)]
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in of)
    sums, most = [sum(r["size"] for r in rs) for rs in of], max(r["size"] for r in got)
    assert max(sums) - min(sums) <= 2 * most
    again = sharding.shard(docs.repartition(3), shards=40, ranges=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def secret_texts(rng):
    bits = ["token", "Password", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "x", "secret", "aa==", ".", "-", "AKIAAKIA", "f" * 24]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]


def test_secrets(spark):
    rng = random.Random(7)
    rows = odd_rows() + [(1000 + k, t) for k, t in enumerate(secret_texts(rng))]
    rows += [(5000, 'token: "token" = longvalue'), (5001, "-----BEGIN PRIVATE KEY-----\nMIIB\n-----END PRIVATE KEY-----"), (5002, "a" * 100_000 + " api_key=" + "b" * 40_000)]
    docs = documents(spark, rows).withColumnsRenamed({"doc_id": "path"}).withColumn("version", F.lit(1))
    found, ledger = secrets.scan(docs)
    text = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    got = sorted(((r["path"], r["x"]) for r in found.select("path", text(secrets.BASE_KINDS).alias("x")).collect()), key=str)
    assert got == sorted(((d, spans(t or "")) for d, t, *_ in rows), key=str)
    assert found.filter("path = 5001").select(text(["pem"]).alias("x")).first()["x"].startswith("pem:0:")
    assert ledger.select("blob_id").distinct().count() == len({t or "" for _, t, *_ in rows})
    assert secrets.scan(docs.limit(0))[0].count() == 0


def test_ledger(spark):
    rows = [("a", 1, "token = abcdefgh"), ("a", 2, "nothing"), ("b", 1, "token = abcdefgh"), (None, None, None)]
    versions = spark.createDataFrame(rows, "path string, version int, text string")
    first, ledger = secrets.scan(versions)
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    again, new = secrets.scan(versions, ledger)
    assert new.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    # A new version of a rule, and a new blob, are the only pairs that are scanned.
    rules = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2) if r.kind == "hex" else r for r in secrets.RULES)
    more = versions.unionByName(spark.createDataFrame([("c", 1, "f" * 30)], versions.schema))
    found, new = secrets.scan(more, ledger, rules)
    pairs = [(r["blob_id"], r["kind"]) for r in new.collect()]
    assert len(pairs) == len(set(pairs)) == 3 + len(secrets.RULES)
    assert {r["path"]: len(r["spans"]) for r in found.filter("version = 1").collect()} == {"a": 1, "b": 1, "c": 1}
    assert hashlib.sha256(b"").hexdigest() in {r["blob_id"] for r in found.collect()} and json.dumps(rows)


def test_groups_of_equal_texts_share_a_shard(spark):
    """Groups of up to a tenth of a shard's share are whole, larger ones are split, and sizes stay within that of each other."""
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(1, 60))) for k in range(1500)]
    rows += [(2000 + 10 * g + k, f"group {g} " + "x" * 60) for g in range(120) for k in range(rng.randint(2, 6))] + [(9000 + k, "many copies") for k in range(900)] + [(7, "one id") for _ in range(50)]
    got = sharding.shard(documents(spark, rows).repartition(4), shards=40, ranges=64).collect()
    size = lambda t: len(t.encode()) + 16
    share, of = sum(size(t) for _, t in rows) / 40, {}
    for r in got:
        of.setdefault(r["text_crc32"], []).append(r)
    for t in {t for _, t in rows}:
        found = of[zlib.crc32(t.encode())]
        if sum(r["size"] for r in found) <= 0.1 * share:
            assert len({r["shard"] for r in found}) == 1
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(40)]
    assert all(abs(x - share) <= 0.1 * share + 2 * max(size(t) for _, t in rows) for x in sums) and len({r["shard"] for r in of[zlib.crc32(b"many copies")]}) > 1
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_ledger_of_two_runs(spark):
    """A run with more rules scans only the pairs that the ledger lacks; both together find what one run finds."""
    rng = random.Random(10)
    texts = secret_texts(rng) + ["-----BEGIN PRIVATE KEY-----\nabc=\n-----END PRIVATE KEY----- token=abcdefgh"] * 40
    versions = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "path long, version int, text string")
    blobs = secrets.blob_store(versions)
    first = secrets.unseen(blobs, None, secrets.RULES[:3])
    found, new = secrets.scan(versions, first, secrets.RULES, blobs)
    assert {r["kind"] for r in first.select("kind").distinct().collect()} == {"assign", "access", "hex"} and {r["kind"] for r in new.select("kind").distinct().collect()} == {"pem", "jwt"}
    whole = {r["path"]: r["spans"] for r in secrets.scan(versions)[0].collect()}
    assert {r["path"]: r["spans"] for r in found.collect()} == whole and any(s["kind"] == "pem" for x in whole.values() for s in x)
