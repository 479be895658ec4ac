"""Inputs and brute-force versions shared by the tests."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SYLLABLES = "ka to ri mu en sha dor el vin as tre po li gna ck é ü".split()

#: Names that the operators use inside; they must not clash.
CLASHING = ("words", "size", "key", "h", "n", "row", "spans", "_row", "n_words", "kept", "shard", "cls", "text_crc32", "turns", "weight", "bucket", "hash", "d", "copies", "doc")


def prose(rng, n, lines=False):
    """Invented words; some are frequent."""
    frequent = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]
    out = [rng.choice(frequent) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if lines:
        return "\n".join(" ".join(out[i : i + 9]) for i in range(0, n, 9))
    return " ".join(out)


def documents(spark, rows, clash=True):
    """A table of documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
    extra = CLASHING if clash else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)


def odd_rows(seed=1):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, other scripts."""
    rng = random.Random(seed)
    text, long_ = prose(rng, 120, lines=True), prose(rng, 30_000, lines=True)
    return [(0, None), (1, ""), (2, " \n\t \r\n"), (3, text), (4, text), (4, text), (None, text), (None, prose(rng, 60)), (5, long_), (6, "一二三 四五 " * 30), (7, "one two three"), (8, "One TWO three"), (9, "word"), (10, prose(rng, 80), None, None), (11, "é" * 300)]


def crc_mod(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
