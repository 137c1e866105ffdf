import public_tokenizers
from tokenizers import Tokenizer

from sparquill.llm import token_counts
from sparquill.llm.bpe import byte_bpe

from .conftest import make, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "é", "ß", "１", "²", "\x1c", "\x85", " ", "!", "$$", "<|endoftext|>", "<|endo", "漢", "😀", "İ", "́", "\r\n", "ing", "12", "don't", "-" * 41, ",", "."]


def test_every_prefix_is_exact(rnd):
    tk, c = Tokenizer.from_file(PATH), token_counts.prefix_counter(PATH)

    def ids(s):
        return tk.encode(s, add_special_tokens=False).ids

    for _ in range(300):
        s = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14)))
        got = c.prefixes(s).tolist()
        assert got == [len(ids(s[:i])) for i in range(len(s) + 1)], repr(s)
        assert byte_bpe(PATH).encode(s) == b"".join(i.to_bytes(4, "little") for i in ids(s))
        for budget in (0, 1, 3):
            n = token_counts.fits_within(got, budget)
            assert got[n] <= budget and all(x > budget for x in got[n + 1 :])


def test_counts_of_a_table(spark, rnd, odd):
    rows = odd + [(100 + i, words(rnd, 50) + ".\n" + words(rnd, 5)) for i in range(30)] + [(800, "a" * 3000), (801, "<|endoftext|>" * 600)]
    tk = Tokenizer.from_file(PATH)
    def size(t):
        return len(tk.encode(t, add_special_tokens=False).ids)

    want = []
    for i, t in rows:
        t = t or ""
        n = size(t)
        # Counts may fall by a few tokens only, so no prefix a hundred code points past the first that is over the limit is within it.
        first = next((k for k in range(513, len(t) + 1) if size(t[:k]) > 512), len(t) + 1) if 512 < n and len(t) < 9999 else len(t) + 1
        most = max((k for k in range(min(first + 100, len(t)) + 1) if size(t[:k]) <= 512), default=0) if first <= len(t) else None
        want.append((i, len(t.encode()), n, n > 512, most if n > 512 else len(t)))
    out = token_counts.counts(make(spark, rows, "n_tokens over_limit"), PATH).collect()
    want = [(*w[:4], next(r.limit_chars for r in out if r.doc_id == w[0])) if w[4] is None else w for w in want]  # the longest is looked at below
    long = next(r for r in out if r.doc_id == 4)
    assert size(odd[3][1][: long.limit_chars]) <= 512 < min(size(odd[3][1][: long.limit_chars + k]) for k in range(1, 60))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    table = token_counts.prefix_table(make(spark, rows[:3]), PATH).collect()
    assert all(len(r.prefix_tokens) >= 1 and r.prefix_tokens[0] == 0 for r in table)
    assert token_counts.counts(make(spark, []), PATH).count() == 0


def test_long_runs(rnd):
    """Runs that the library's own pattern matcher does not survive are counted and encoded as the tokenizer does."""
    tk, c, b = Tokenizer.from_file(PATH), token_counts.prefix_counter(PATH), byte_bpe(PATH)
    for t in (" \n" * 300_000, "a" + " " * 150_001 + "b", "-" * 60_000, "x7k" * 40_000, "\x1c " * 40_000 + "é" * 9000, "del " * 50_000):
        ids = tk.encode(t, add_special_tokens=False).ids
        assert b.encode(t) == b"".join(i.to_bytes(4, "little") for i in ids)
        got = c.prefixes(t)
        assert len(got) == len(t) + 1 and got[-1] == len(ids)
