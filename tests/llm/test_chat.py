import hashlib
import random

from pyspark.sql import functions as F

from fleetbook.llm import chat
from fleetbook.llm.queries import with_special
from llm.util import empty

TURNS = "conv_id long, turn long, role string, text string"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def formatted(spark, rows):
    return chat.format_paths(chat.reply_paths(chat.link_turns(spark.createDataFrame(rows, TURNS))))


def test_any_text_comes_back(spark):
    rng = random.Random(1)
    parts = ["\\", "#", "##", "### ", "</turn>", "</turn>\n", "<\\/turn>", "</", "turn>", "\n", ": ", "é", "user", "</turn"]
    want, rows = {}, []
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", "a: b", "x\\:", ""]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 6))]
        want[c] = turns
        rows += [(c, n, r, t) for n, (r, t) in enumerate(turns)]
    out = formatted(spark, rows)
    for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        loss = [s["text"] for s in r["segments"] if s["loss"]]
        assert len(loss) == sum(x == "assistant" for x, _ in want[r["conv_id"]])
    for r in chat.conversation_digests(out).collect():
        turns = want[r["conv_id"]]
        said = "".join(t for x, t in turns if x == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest(turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_nulls_ties_and_order(spark):
    rows = [(1, 2, "assistant", None), (1, None, "user", "first"), (1, 1, None, "b"), (1, 1, None, "a"), (None, 0, "user", "no id")]
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted(spark, rows)).collect()}
    assert got[1]["turns_sha256"] == digest([("user", "first"), ("", "a"), ("", "b"), ("assistant", "")])
    assert got[None]["n_turns"] == 1
    assert chat.conversation_digests(chat.format_paths(chat.reply_paths(chat.link_turns(empty(spark, TURNS))))).count() == 0


def test_special_conversation(spark):
    got = chat.conversation_digests(chat.format_paths(chat.reply_paths(chat.link_turns(with_special(empty(spark, TURNS)))))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(-7, 2, len("\\### Assistant: </turn> ok"))]


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "good"), (1, 3, 1, 0.5, "assistant", "bad"),
         (1, 4, 2, -2.0, "user", "meh"), (1, 5, 3, 0.0, "user", "thanks"), (1, 6, 2, 0.0, "user", "more"),
         (1, 7, 99, 0.0, "user", "orphan"), (2, 1, 2, 0.0, "user", "cycle"), (2, 2, 1, 0.0, "user", "cycle")],
        "conv_id long, node_id long, parent_id long, score double, role string, text string")
    best = {(r["conv_id"], r["path_id"]): [s["text"] for s in r["segments"][1::3]] for r in chat.format_paths(chat.reply_paths(nodes)).collect()}
    assert best == {(1, 6): ["q", "good", "more"], (1, 7): ["orphan"]}
    two = chat.format_paths(chat.reply_paths(nodes, branches=2)).select("path_id").collect()
    assert sorted(r[0] for r in two) == [5, 6, 7]


def test_long_chain(spark):
    rows = [(5, n, "user" if n % 2 else "assistant", str(n)) for n in range(70)]
    got = chat.conversation_digests(formatted(spark, rows)).first()
    assert got["turns_sha256"] == digest([(r, t) for _, _, r, t in rows])


def test_plan_is_native(spark):
    df = chat.conversation_digests(formatted(spark, [(1, 0, "user", "x")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
