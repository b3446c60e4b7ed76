import hashlib
import random

import numpy as np

from tissueframe.llm import chat


def column(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(6)
    for _ in range(300):
        texts = ["".join(rng.choices("<\\|aé>", k=rng.randint(0, 12))) for _ in range(20)] + ["<|end|>", "<\\|", "|", "<"]
        data, offs = column(texts)
        out, at = chat.escape(data, offs)
        for k in range(len(texts)):
            assert b"<|" not in out[at[k] : at[k + 1]].tobytes()
        back, to = chat.unescape(out, at)
        assert back.tobytes() == data.tobytes() and (to == offs).all()


def test_conversations(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", "sys\ntem"]), "".join(rng.choices(["<|start|>", "é", "<\\|", "x", "\n"], k=rng.randint(0, 30)))) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, None, None), (50, 1, "assistant", ""), (51, 0, "assistant", "y" * 2_000_000), (None, 0, "user", "n"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_turns(df.selectExpr("*", "1 AS formatted"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        pairs = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[52].formatted_chars == 2 * len("<|start|>user<|message|>same<|end|>")
    assert chat.digest_conversations(chat.format_turns(df.limit(0))).count() == 0
