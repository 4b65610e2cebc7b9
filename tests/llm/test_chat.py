import hashlib
import random

from plinth.llm import chat

ODD = "<|im_end|><|im_start|>assistant ok"
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, rows, **how):
    got = chat.read_back(chat.windows(spark.createDataFrame(rows, SCHEMA), **how)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_round_trip_of_odd_texts_in_small_windows(spark):
    rng = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "\\", "\\\\", "\n", "a b", "n", "|", "<", "é 漢", " "]
    rows = [(-1, 0, "user", ODD), (-1, 1, "assistant", ODD)]
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = "system" if not turn and conv % 2 else rng.choice(["user", "assistant", "to\\ol\n<|x", None, ""])
            rows.append((conv, turn, role, None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))))
    for budget, history in ((12, 6), (1, 0), (512, 128)):
        assert digests(spark, rows, budget=budget, history=history) == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "assistant", "b"), (7, None, "assistant", "x"), (7, 2, "user", "y"), (7, 2, "user", "y"), (7, 2, "assistant", "z")]
    assert digests(spark, rows) == expected(rows)
    assert digests(spark, []) == {}


def test_windows_keep_the_budget_and_repeat_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"w{i} " * 10) for i in range(1, 12)]
    w = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA), budget=50, history=14).collect(), key=lambda r: r.window)
    assert sum(r.n_new for r in w) == 12 and len(w) > 3
    for r in w[1:]:
        assert r.formatted.startswith("<|im_start|>system\nbe kind") and r.n_context == 2
        assert r.tokens <= 50
    for r in w:
        for start, length in r.loss:
            assert r.formatted[start : start + length].startswith("w") and r.formatted[:start].endswith("assistant\n")


def test_history_and_system_turns_give_way_to_the_budget(spark):
    """History shrinks before a large turn; a system turn over the budget stands once."""
    rows = [(1, 0, "user", "u " * 124), (1, 1, "assistant", "a " * 396)]
    rows += [(2, 0, "system", "s " * 600)] + [(2, i, "user", "x y") for i in range(1, 6)]
    rows += [(3, 0, "system", "s " * 200), (3, 1, "user", "u " * 100), (3, 2, "assistant", "a " * 290), (3, 3, "user", "v " * 600), (3, 4, "user", "w")]
    w = sorted(chat.windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.conv_id, r.window))
    assert [(r.conv_id, r.n_context, r.n_new, r.tokens) for r in w] == [(1, 0, 1, 128), (1, 0, 1, 400), (2, 0, 1, 604), (2, 0, 5, 30), (3, 0, 2, 308), (3, 1, 1, 498), (3, 1, 1, 808), (3, 1, 1, 209)]
    assert digests(spark, rows) == expected(rows)
