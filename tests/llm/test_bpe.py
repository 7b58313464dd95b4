import base64
import os
import random

import pytest

from talkgrid.llm import bpe
from talkgrid.llm.queries import BYTE_BPE

tiktoken = pytest.importorskip("tiktoken")
if not os.path.exists(BYTE_BPE):
    pytest.skip("no vocabulary", allow_module_level=True)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encoding():
    with open(BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_a_public_encoder(spark, encoding):
    r = random.Random(3)
    pieces = ["it's", " we'll", "'ve", "  ", "\n\n", "\t", " x", "会議", "。", "ไทย", "हिन्दी", "3.14", "½", "é", "́", "　", "​", "<|endoftext|>", "🙂", "'", '"', "ABC", "\x1c"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(400)] + ["a" * 500, "漢字" * 400, "", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {x.doc_id: x.ids for x in bpe.encode_column(df, "doc_id", "text", BYTE_BPE).collect()}
    for i, t in enumerate(texts):
        assert got[i] == encoding.encode_ordinary(t or ""), t
        assert encoding.decode(got[i]) == (t or "")
    assert {x.doc_id: x.n_tokens for x in bpe.encode_column(df, "doc_id", "text", BYTE_BPE, lengths_only=True).collect()} == {k: len(v) for k, v in got.items()}


def test_wide_and_narrow_rows_agree():
    v = bpe.Vocabulary.load(BYTE_BPE)
    words = [("word" * n).encode() for n in range(1, 30)] + ["予算の話".encode() * 3]
    r = random.Random(6)
    words += [b"a" * n for n in range(1, 40)] + [bytes(r.choice(b"abcde \xe4\xba\x88the") for _ in range(r.randint(1, 150))) for _ in range(200)]
    assert all(v._wide(w).tolist() == v._matrix([w])[1].tolist() for w in words)
    assert len(v._wide(b"ab" * 500_000)) < 1_000_000


def test_empty_table(spark):
    assert bpe.encode_column(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", BYTE_BPE).count() == 0
