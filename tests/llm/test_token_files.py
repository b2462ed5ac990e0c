from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tabgate.llm import token_files as T
from tabgate.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    ids[rng.random(n) < 0.5] %= 7
    blocks = T.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    assert len(blocks) == -(-n // T.BLOCK)
    assert T.decode_blocks(b"".join(blocks), starts).tolist() == ids.tolist()


def test_outliers_are_exceptions():
    ids = np.full(T.BLOCK, 10)
    ids[::100] = 40_000
    (block,) = T.encode_blocks(ids)
    n, n_large, width, least = T.HEAD.unpack_from(block)
    assert (n, n_large, width, least) == (T.BLOCK, 6, 0, 10) and len(block) == T.HEAD.size + 6 * 6


def test_files_round_trip_in_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 999, int(n))), 0) for i, n in zip(rng.permutation(120), rng.integers(0, 400, 120))]
    rows += [(500, None, 1), (501, "", 1), (7, "again", 1), (7, "again", 1), (None, "no id", 1), (502, "x " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    files, folder = T.write_files(docs, PATH, f"file://{tmp_path}/ids")
    got = sorted(T.read_files(files, folder).collect(), key=lambda r: r.start)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(encoder(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        at += len(ids)
    assert not any(want.values())
    row = files.first()
    one = T.TokenFile(folder, row.file)
    assert one.ids(1, 2).tolist() in [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got]


def test_empty_table(spark):
    files, folder = T.write_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert files.count() == 0 and T.read_files(files, folder).count() == 0
