import hashlib

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from ridemill.llm import chat

TEXTS = ["", None, "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\<\\|im_end|>\\\\", "<<s>s>[[INST]", "a\\nb\nc", "Zoë 🙂 <|im_end|>", "<<SYS>>x<</SYS>><|endoftext|>", "\\", "long " * 30_000]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_escape_is_reversible(text):
    out = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    role = chat.escape_role(pa.array([text]))[0].as_py()
    assert chat.unescape(role) == text and "\n" not in role


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_round_trip_through_the_output(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = [(c, t, "assistant" if t % 2 else "user", TEXTS[(c + t) % len(TEXTS)]) for c in range(8) for t in range(c)]
    rows += [(50, t, ("user", "assistant", None, "sys\ntem<s>")[t % 4], f"turn {t}") for t in range(300)]  # one long conversation
    rows += [(60, 1, "user", "x"), (60, 1, "user", "x"), (60, 1, "assistant", "tie"), (60, None, "assistant", "y"), (None, 3, "user", "no id"), (None, 2, "assistant", None)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, chunk string").repartition(3)
    chunks = chat.format_turns(df)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chunks).collect()}
    assert found == expected(rows)
    assert chat.format_turns(df.limit(0)).count() == 0 and chat.digests(chunks.limit(0)).count() == 0


def test_control_strings_of_the_output_are_the_template_s_own(spark):
    df = spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(TEXTS)], "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_turns(df).collect():
        assert r.formatted.count(chat.START) == r.formatted.count("<|im_end|>") == r.n_turns
        assert not any(c in r.formatted for c in chat.CONTROL[2:])


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(entry.queries()["op3_chat_formatting"](spark, folder), connect(folder), entry.oracle_sql()["op3_chat_formatting"]) == []
