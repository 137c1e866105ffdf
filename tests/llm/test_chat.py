import hashlib

from sparquill.llm import chat

PARTS = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "\n", "user", "assistant", "é", "im_end|>", "<\\\\|im_end|>", "\\n", "\\l"]


def test_any_turn_parses_back(rnd):
    for _ in range(3000):
        role, text = ("".join(rnd.choice(PARTS) for _ in range(rnd.randrange(7))) for _ in range(2))
        out = chat.formatted(role, text)
        assert chat.parse(out) == [(role, text)]
        assert chat.unescape(chat.escape(text)) == text
    assert chat.formatted("user", "plain < text") == "<|im_start|>user\nplain < text<|im_end|>\n"
    assert chat.parse("<|im_start|>user\nno end") is None and chat.parse("x") is None


def test_conversations_parse_back_whole(rnd):
    turns = [(rnd.choice(("user", "assistant")), "".join(rnd.choice(PARTS) for _ in range(5))) for _ in range(30)]
    assert chat.parse("".join(chat.formatted(*t) for t in turns)) == turns


def test_summary_against_the_source(spark, rnd):
    rows = [(c, t, rnd.choice(("user", "assistant")), "".join(rnd.choice(PARTS) for _ in range(6))) for c in range(40) for t in range(rnd.randrange(1, 8))]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (None, 0, "assistant", "x"), (101, 0, "assistant", "tie"), (101, 0, "assistant", "tie"), (101, None, "user", "first")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as n_turns", "2 as formatted")
    got = {r.conv_id: r for r in chat.summary(df).collect()}
    assert len(got) == len({c for c, *_ in rows})
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: tuple((v is not None, v) for v in x[1:]))
        own = [(role or "", text or "") for _, _, role, text in own]
        said = [t for role, t in own if role == "assistant"]
        assert r.n_turns == len(own) and r.loss_chars == sum(map(len, said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.formatted(*t)) for t in own)
    assert chat.summary(df.limit(0)).count() == 0
    assert chat.turns(df).count() == len(rows)
