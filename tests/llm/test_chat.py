from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabgate.llm import chat as C
from tabgate.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.text(st.one_of(st.sampled_from("<[|\\>]/s\n"), st.characters(exclude_categories=["Cs"]))), st.text(st.sampled_from("<|>\\a\n")))
def test_escapes_are_reversible_and_hide_control_strings(text, role):
    assert C.unescape(C.escape(text)) == text
    for control in ("<|", "</s>", "[INST]", "[/INST]", "|>", "<s>"):
        assert control not in C.escape(text + control)
    turns = [(role, text), ("assistant", "x" + text)]
    assert C.parts_of("".join("".join(C.part(*t)) for t in turns)) == turns


def case() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(25):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be kind </s> [INST] <|end|>\n" + "\\" * (conv % 5)))
        for turn in range(1, int(rng.integers(2, 12))):
            text = " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 40))))
            rows.append((conv, turn, "assistant" if turn % 2 == 0 else "user", text or None))
    rows += [(70, 0, "user", "</s>[INST] ok [/INST]"), (70, 1, "assistant", "</s>[INST] ok [/INST]"), (71, 0, "assistant", "long " * 900)]
    rows += [(72, 5, None, None), (72, 5, None, None), (72, None, "assistant", "é"), (None, 1, "user", "no id"), (73, 0, "we|ird<|>\n", "x")]
    rows += [(74, 3 * t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(1, 90)] + [(74, 0, "system", "long one")]
    return rows


def wanted(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("long", [4096, 40])
def test_windows_read_back_to_all_turns(spark, monkeypatch, long):
    monkeypatch.setattr(C, "LONG", long)
    rows = case()
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, segment int").repartition(5)
    windows = C.format_windows(turns, PATH, budget=120)
    got = {r.conv_id: tuple(r)[1:5] for r in C.digests(windows).collect()}
    assert got == wanted(rows)
    seen = defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: (repr(w.conv_id), w.segment, w.window)):
        assert w.n_tokens == sum(len(encoder(PATH).tokenizer.encode("".join(C.part(*p))).ids) for p in C.parts_of(w.text))
        assert w.over_budget == (w.n_tokens > 120) and (not w.over_budget or w.n_turns - w.n_repeated == 1)
        parts = C.parts_of(w.text)
        assert len(parts) == w.n_turns > w.n_repeated
        # What is repeated is the system turn and the last turns before, as far as a fourth of the budget goes.
        seen[w.conv_id].append((w.segment, parts[: w.n_repeated], parts[w.n_repeated :]))
    for conv, own in seen.items():
        before: list = []
        for segment, repeated, new in own:
            rest = repeated[1:] if repeated and repeated[0][0] == "system" else repeated
            assert rest == before[len(before) - len(rest) :]
            assert sum(len(encoder(PATH).tokenizer.encode("".join(C.part(*p))).ids) for p in rest) <= 30
            before += new
    assert all(r[1][0] == ("system", "long one") for r in seen[74][1:])
    assert max(s for s, *_ in seen[74]) == (0 if long == 4096 else max(s for s, *_ in seen[74])) and len(seen[74]) > 3


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_windows(turns, PATH)).collect() == []
