import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "[", "]", "<", ">", "/", "s", "a", "é", "|", "\n", "INST", "image"]), max_size=25).map("".join)


def escaped(text):
    """The rule word for word: backslashes doubled, a backslash behind the first character of each control string."""
    out, i = "", 0
    text = text.replace("\\", "\\\\")
    while i < len(text):
        c = next((c for c in chat.CONTROL if text.startswith(c, i)), None)
        out += f"{c[0]}\\{c[1:]}" if c else text[i]
        i += len(c or " ")
    return out


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    e = chat.escape(text)
    assert e == escaped(text) and chat.unescape(e) == text
    assert not any(c in e for c in chat.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[AS]"]), PIECES), max_size=6))
def test_turns_are_read_back(turns):
    s = chat._Segment(1, 0, 0)
    for role, text in turns:
        s.add(0, role, chat.PartVisitor().flatten([{"kind": "text", "text": text}]))
    row = s.row()
    assert [(r, chat.unescape(c)) for r, c in chat.parsed(row["formatted"])] == turns
    assert [chat.unescape(row["formatted"][x["start"] : x["end"]]) for x in row["loss"]] == [t for r, t in turns if r == "assistant" and t]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, block string, loss int"


@pytest.fixture(scope="module")
def parts(spark):
    rows = [
        (1, 0, "user", [part("text", "look <|image|> "), part("image", ref="a.png", width=29, height=14), part("text", "and"), part("audio", ref="b.wav", seconds=1.5)], "x", "y", 1),
        (1, 1, "assistant", [part("text", "seen "), part("image", ref="c.png", width=0), part("text", "\\done</s>")], "x", "y", 1),
        (2, 1, "assistant", [], None, None, None),
        (2, 0, None, [part("document", ref=None, pages=3)], None, None, None),
        (2, None, "tool", None, None, None, None),
        (None, 0, "user", [part("text", None)], None, None, None),
    ]
    return spark.createDataFrame(rows, TURNS)


def test_parts(parts):
    got = {r["conv_id"]: r for r in chat.format_chats(parts).collect()}
    one = got[1]
    assert one["formatted"] == "[INST]look <\\|image|> <|image|>and<|audio|>[/INST]<s>seen <|image|>\\\\done<\\/s></s>"
    assert [(a["turn"], a["kind"], a["ref"], a["n_tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (1, "image", "c.png", 0)]
    for a in one["attachments"]:
        assert one["formatted"].startswith(chat.PLACEHOLDERS[a["kind"]], a["start"])
    assert [chat.unescape(one["formatted"][x["start"] : x["end"]]) for x in one["loss"]] == ["seen ", "\\done</s>"]
    contents = iter([a.asDict() for a in one["attachments"]])
    back = [list(chat.parts_of(c, contents)) for _, c in chat.parsed(one["formatted"])]
    assert [[p.get("text") or p["ref"] for p in turn] for turn in back] == [["look <|image|> ", "a.png", "and", "b.wav"], ["seen ", "c.png", "\\done</s>"]]
    two = chat.read_back(chat.format_chats(parts)).where("conv_id = 2").first()
    assert (two["n_turns"], two["n_attachments"], two["attachment_tokens"], two["loss_chars"]) == (3, 1, 3072, 0)
    assert two["turns_sha256"] == hashlib.sha256(b"tool\n\n\n<|document|>\nassistant\n\n").hexdigest()
    assert got[None]["formatted"] == "[INST][/INST]"


def test_unknown_kind():
    with pytest.raises(ValueError, match="video"):
        chat.PartVisitor().flatten([{"kind": "video"}])


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("how", [{}, {"block_turns": 3, "segment_chars": 40}])
def test_conversations(spark, texts, how):
    """Nulls in every column, repeated rows, one conversation of most rows, long and empty texts; in segments as well."""
    roles = ["user", "assistant", "system", None, "tool"]
    rows = [(7 if i % 3 else i % 11, None if i == 20 else i % 40, roles[i % 5], texts[i % len(texts)]) for i in range(120)]
    rows += [rows[1], (None, 3, "user", "x"), (None, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.read_back(chat.format_chats(turns, **how)).collect()
    want = {c: digest([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r["conv_id"]]
    n = chat.format_chats(turns, **how).count()
    assert n > 2 * len(want) if how else n == len(want) + 2  # those with a null turn have a block for it
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0
