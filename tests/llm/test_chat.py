import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgraph.llm import chat

TEXTS = st.text(alphabet="ab \\#</turn>:\né*=", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "System", "=x", ""]), TEXTS), TEXTS), max_size=6))
def test_round_trip(turns):
    rows = [chat.Turn(r, t, 1, 1) for r, t in turns]
    text, mask = chat.render([], rows)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[m["first"] : m["stop"]]) for m in mask] == [t for r, t in turns if r == "assistant" and t]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=30), st.booleans(), st.integers(0, 3))
def test_spans(tokens, system, history):
    spans, windows = chat.Spans(40, history, 20), []
    for k, n in enumerate(tokens):
        closed = spans.push("system" if system and k == 0 else "user", str(k), n)
        windows += [closed] if closed else []
    windows.append(spans.close())
    assert [int(t.text) for _, fresh in windows for t in fresh] == list(range(len(tokens)))
    for k, (repeated, fresh) in enumerate(windows):
        total = sum(t.tokens for t in [*repeated, *fresh])
        held = tokens[0] if system and k else 0
        assert total <= 40 or (len(fresh) == 1 and held + fresh[0].tokens > 40 and len(repeated) == (held > 0))
        assert not repeated if k == 0 else (repeated[:1] == [windows[0][1][0]]) or not system
        own = [int(t.text) for t in repeated if not (system and t.text == "0")]
        assert own == list(range(int(fresh[0].text) - len(own), int(fresh[0].text))) and len(own) <= history


def rows():
    out = [(1, t, "system" if t == 0 else ("user" if t % 2 else "assistant"), f"turn {t} " + "word " * (t * 37 % 300)) for t in range(40)]
    out += [(2, 0, "user", None), (2, 1, None, "who?"), (2, None, "assistant", "last"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    out += [(None, 0, "user", "no id"), (3, 0, "assistant", "big " * 5000), (4, 0, "tool: x", chat.TRICKY), (4, 1, "assistant", chat.TRICKY), (5, 0, "assistant", "")]
    return out


def expected(data):
    out = []
    for conv in {r[0] for r in data}:
        turns = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss)))
    return sorted(out, key=str)


def frame(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, window string")


@pytest.mark.parametrize("budget", [20, 300, 100_000])
def test_read_back(spark, budget):
    windows = chat.format_windows(frame(spark, rows()).repartition(3), budget=budget)
    got = sorted((tuple(r)[:5] for r in chat.read_back(windows).collect()), key=str)
    assert got == expected(rows())
    for w in windows.collect():
        assert w.over_budget == (w.tokens > budget)
        assert len(chat.parse(w.text)) == w.n_turns
        if w.over_budget:  # a turn that even after the system turn alone is too much
            assert w.n_turns - w.n_repeated == 1 and w.n_repeated <= 1


def test_history_gives_way(spark):
    """The system turn and the assistant's fit the budget, the user's before
    it doesn't fit with them."""
    said = [("system", 100), ("user", 200), ("assistant", 700), ("user", 200), ("assistant", 800)]
    data = [(1, k, role, "w " * n) for k, (role, n) in enumerate(said)]
    got = chat.format_windows(frame(spark, data), budget=1024).orderBy("window").collect()
    assert [(w.tokens, w.n_repeated, w.n_turns, w.over_budget) for w in got] == [(1012, 0, 3, False), (308, 1, 2, False), (908, 1, 2, False)]


def test_empty(spark):
    assert chat.format_windows(frame(spark, []) if False else frame(spark, rows()).where("1 = 0")).collect() == []


def test_tokenizer(spark):
    from pathlib import Path

    path = Path("/opt/tokenizers/word_bpe_49k.json")
    if not path.exists():
        pytest.skip("no tokenizer files")
    windows = chat.format_windows(frame(spark, rows()[:10]), tokenizer=str(path), budget=200).collect()
    assert sum(w.n_turns - w.n_repeated for w in windows) == 10
