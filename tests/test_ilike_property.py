"""``contains_ci`` equals Postgres ``ILIKE '%' || term || '%'`` on random terms and texts."""
import random
import re

from fleetbook.functions.predicates import contains_ci

ALPHABET = ["a", "B", "c", "%", "_", "\\", "x"]


def pg_ilike_contains(text: str, term: str) -> bool:
    """Model: backslash escapes the next character; % any run; _ one character; case-folded."""
    pattern, out, i = "%" + term + "%", [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1].lower()))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch.lower()))
        i += 1
    return re.fullmatch("".join(out), text.lower(), flags=re.S) is not None


def test_contains_ci_matches_model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    terms = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for term in terms:
        got = {r["i"] for r in df.filter(contains_ci("s", term)).select("i").collect()}
        want = {i for i, s in enumerate(texts) if pg_ilike_contains(s, term)}
        assert got == want, term
