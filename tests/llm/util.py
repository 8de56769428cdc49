"""Small tables for the corpus operators."""
import random

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}x" for _ in range(n))


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:   # names that the operators use themselves
        for c in ("rep", "n", "mean", "size", "slot", "block", "key", "mix_of", "qs_text", "kept"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def odd_texts(seed=3):
    """Null, empty, blank, tiny, repeated, near and exact copies, a very long text, odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (60, 120, 300)]
    near = []
    for k in range(6):
        w = base[1].split()
        w[7 * k + 3] = f"new{k}"
        near.append(" ".join(w))
    return [None, "", " \t\n", "one", "Two Words", "three little words", "a\x0bb\x0cc\r\nd", base[0], base[0],
            base[0].upper(), *near, base[1], base[2], base[2] + " tail", "é ü " * 40 + base[0][:200],
            prose(rng, 9000, 5000), "x" * 300, "x" * 120, "▁ odd   spaces\u0085here", "rep " * 200]


def empty(spark, schema=DOC):
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
