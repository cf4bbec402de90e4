"""Small tables with the awkward cases, and plain restatements of the contracts."""

import random
import zlib

import public_tokenizers

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def fold(doc_id, parts=5):
    return zlib.crc32(str(doc_id).encode()) % parts


def awkward(n=60, seed=3):
    """Texts with nulls, empties, blanks, ties, copies, near copies, odd characters and a very long one."""
    draw = random.Random(seed)
    pool = ["Alpha", "beta", "gamma,", "délta", "x", "The", "the", "漢字", "🙂", "#tag", "a|b", "99", "zeta.", "eta\tTheta", "İ", "K", "ß"]
    texts = [None, "", " ", "\n", "\n\n", "one", "one two", "ONE two", "one  two\n", "\x0b\x1c x", "word " * 3, "▁ a▁b", "<s> </s> <unk> <0x0A>", "\x00nul", "a\rb", "�"]
    for _ in range(n):
        texts.append("\n".join(" ".join(draw.choice(pool) for _ in range(draw.randrange(0, 12))) for _ in range(draw.randrange(1, 6))))
    base = " ".join(draw.choice(pool) + str(k % 40) for k in range(300))
    texts += [base, base, base + " end", base.replace("x7", "y7"), "shared passage line here\n" + base[:200], "Shared Passage line here \nother", "long " * 20_000, "y" * 50_000]
    rows = [(k * 3 % 101 + k // 101 * 200, t, draw.choice(["en", "de", None]), "src0", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[-3], (None, "null id text with more than ten chars", "en", None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
