import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loamdex.llm import encode as E, packing as P

REFERENCE = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
REFERENCE.encode_special_tokens = True


def library(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = E.encode(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["ids"] == library(texts[r["doc_id"]]) for r in rows)
    n = E.encode(docs, out="n", lengths_only=True).collect()
    assert {r["doc_id"]: r["n"] for r in n} == {r["doc_id"]: len(r["ids"]) for r in rows}


CASES = ["", None, " ", "\n\n  x", "a   b \t c  d", "<|endoftext|>", "it's we'll  can't", "é ﬁ 👩‍💻 日本語 \x1c x　y", "x" * 5000, "a b " * 3000, "\r\n\r\n", "  lead and trail  "]


def test_edge_texts(spark):
    df = spark.createDataFrame([(i, t, "ids clash") for i, t in enumerate(CASES)], "doc_id long, text string, ids string")
    assert {r["doc_id"]: r["ids"] for r in E.encode(df).collect()} == {i: library(t) for i, t in enumerate(CASES)}
    assert E.encode(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=8, unique=True))
def test_replay_decodes(words):
    _, tokens = E.vocabulary(E.DEFAULT_VOCABULARY)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    assert [b"".join(tokens[i] for i in ids) for ids in E.replay_merges(raw, E.DEFAULT_VOCABULARY)] == raw


def sizes_frame(spark, sizes):
    return spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens int, bucket string")


def test_packing(spark):
    r = random.Random(1)
    sizes = [None, 0, 0, 2048, 5000, 2049] + [min(3000, int(r.expovariate(1 / 300)) + 1) for _ in range(3000)]
    rows = P.pack(sizes_frame(spark, sizes), 2048).collect()
    used, held = {}, {}
    for x in rows:
        used[x["container_id"]] = used.get(x["container_id"], 0) + x["n"]
        held.setdefault(x["doc_id"], []).append((x["first"], x["n"]))
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    for i, n in enumerate(sizes):
        if not n:
            assert i not in held
        else:
            at = 0
            for first, k in sorted(held[i]):
                assert first == at
                at += k
            assert at == n and (n > 2048 or len(held[i]) == 1)
    assert sum(used.values()) / (2048 * len(used)) > 0.95


def test_packing_ties_and_empty(spark):
    assert P.pack(sizes_frame(spark, []), 10).count() == 0
    assert P.pack(sizes_frame(spark, [3] * 10), 10).select("container_id").distinct().count() == 4


def test_bounds_are_optimal():
    from itertools import combinations

    h = {3: 5, 4: 1, 9: 2, 10: 7, 15: 1, 16: 3}
    s = sorted(h)
    pad = lambda bounds: sum(h[x] * (min(b for b in bounds if b >= x) - x) for x in s)
    for k in (1, 2, 3, 6):
        best = min(pad([*c, s[-1]]) for c in combinations(s[:-1], k - 1))
        got = P.bucket_bounds(h, k)
        assert len(got) <= k and pad(got) == best
    assert P.bucket_bounds({}) == []


@pytest.mark.parametrize("bounds,counts", [([5, 10], [3, 4]), ([1, 6, 10], [100, 3, 2]), ([10], [0])])
def test_plan_places_all(bounds, counts):
    steps = P.container_plan(bounds, counts, 10)
    room = {}
    for b, n in enumerate(counts):
        for rank in range(n):
            start, per, first = [s for s in steps[b] if s[0] <= rank][-1]
            c = first + (rank - start) // per
            room[c] = room.get(c, 0) + bounds[b]
    assert all(v <= 10 for v in room.values())


def test_bounds_of_a_large_capacity():
    sizes = np.random.default_rng(4).integers(1, 1000, 65536)
    bounds = P.bucket_bounds({i: int(n) for i, n in enumerate(sizes, 1)})
    assert len(bounds) == P.BUCKETS and bounds[-1] == 65536 and bounds == sorted(set(bounds))


def test_fill_against_the_lower_bound(spark, sf):
    """No packing needs fewer containers than all tokens fill, nor than there are items above half a container."""
    from loamdex.llm import queries as Q

    got = Q.p7_fill(spark, sf.replace("0.001", "0.01")).first()
    items = Q.p7_containers(spark, sf.replace("0.001", "0.01"))
    least = max(-(-got["n_tokens"] // 2048), items.where("n > 1024").count())
    assert got["largest"] <= 2048 and items.groupBy("container_id").sum("n").where("sum(n) > 2048").isEmpty()
    assert least <= got["n_containers"] <= 1.06 * least + 2


def test_vocabulary_comes_with_the_job(spark, tmp_path):
    """The file is read where the job brought it, so that its own place may be gone."""
    import shutil

    own = tmp_path / "vocabulary.tiktoken"
    shutil.copy(E.DEFAULT_VOCABULARY, own)
    df = E.encode(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), path=str(own))
    own.unlink()
    assert len(df.first()["ids"]) == 2
