"""The registered queries over whole tables, against the libraries and plain restatements of what they return."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from sparquill.llm import queries as Q

from .test_secret_scan import base
from .test_simhash import brute, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {int(i): x or "" for i, x in zip(t["doc_id"], t["text"])}


@pytest.fixture(scope="module")
def ids(docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tk.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 11)}


def test_op1(spark, docs):
    rows = Q.op1_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op2(spark, ids):
    at, seqs = {}, {}
    for r in Q.op2_best_fit_packing(spark, SF).collect():
        at.setdefault(r.doc_id, {})[r.piece] = r
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at.keys() == ids.keys()
    for i, own in ids.items():
        own, start = [*own, 2], 0
        for k in range(len(at[i])):
            r = at[i][k]
            assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(own[start : start + r.length], "<u4").tobytes())
            assert r.length == 1024 or k == 0
            start += r.length
        assert start == len(own) and (len(at[i]) == 1 or len(own) > 1024)
    for s in seqs.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(seqs) <= -(-sum(len(x) + 1 for x in ids.values()) // 1024) * 1.01 + 1


def test_op4(spark, docs):
    for r in Q.op4_secret_scans(spark, SF).collect():
        want = base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_op6(spark, docs):
    rows = {r.doc_id: r for r in Q.op6_simhash_near_dedup(spark, SF).collect()}
    order = sorted(docs)
    fps = [brute_fp(docs[i]) for i in order]
    root = brute(fps)
    least = {}
    for i, c in zip(order, root):
        least.setdefault(c, i)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{f:016x}", least[c]) for i, f, c in zip(order, fps, root)}


def test_op7(spark, docs, ids):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op7_token_counts(spark, SF).collect()}
    assert got == {i: (len(docs[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}


def test_op8(spark):
    t = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    said = {}
    for c, role, text in zip(t["conv_id"], t["role"], t["text"]):
        said.setdefault(int(c), []).append((role, text or ""))
    said[-1] = [("user", Q.CONFLICT), ("assistant", Q.CONFLICT)]
    rows = {r.conv_id: r for r in Q.op8_chat_formatting(spark, SF).collect()}
    assert rows.keys() == said.keys()
    for c, turns in said.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(rows[c])[1:5] == want and rows[c].formatted_chars >= sum(len(role) + len(x) for role, x in turns)


def test_op10(spark, docs):
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in Q.op10_document_fingerprints(spark, SF).collect()}
    assert sorted(rows, reverse=True) == order
    of_text = {}
    for k, i in enumerate(order):
        t, after = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for text, fp in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert of_text.setdefault(text, fp) == fp
        if t == e:
            assert r.near_edited == 1.0
