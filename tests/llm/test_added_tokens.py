"""Added tokens that stand in a text, against the tokenizers library with its defaults."""

import zlib

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import packing  # noqa: E402
from statuta.llm.encode import Encoder  # noqa: E402

E, S = "<|endoftext|>", "<|startoftext|>"
TEXTS = [f"a b {E} c", f"a{E}b", f"{E}{E}", "", f"x {E}", f"{E} y", f"a  {E}  b", f"d <|endof{E}text|> e", f"{S}a,b{E}!c", "q <|endof", "text|> r", f"don't{E}'s {S} naïve\u0301{E}\u0338z", f"{'w ' * 200}{E}{'v' * 99}", f"{E.upper()} s", f"a\n{E}\n b", f"s{E} {E}1", "<|endoftext|", "> t"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_leaves_added_tokens_to_the_library(file):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    data = [t.encode() for t in TEXTS]
    encoder = Encoder(path)
    for _ in range(2):  # learnt, then remembered
        ids, at = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_packing_of_an_added_token(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, f"a b {E} c"), (2, "a")], "doc_id long, text string")
    got = sorted(map(tuple, packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 64).collect()))
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ([64, 275, 220, 50256, 269, 0], [64, 0])]
    assert got == [(1, 0, 6, crc[0], 6, 0, 0), (2, 0, 2, crc[1], 2, 0, 6)]
