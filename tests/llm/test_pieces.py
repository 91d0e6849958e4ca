import random

import pytest

from lattica.llm import pieces
from lattica.llm.queries import PIECE_MODEL

SPACE = pieces.SPACE


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def brute(v, text):
    t = SPACE + text.replace(" ", SPACE)
    best, back = [0.0] + [float("-inf")] * len(t), [None] * (len(t) + 1)
    for j in range(1, len(t) + 1):
        single = False
        for i in range(max(0, j - v.longest), j):
            node = v.trie
            for c in t[i:j]:
                node = node.get(c) if node else None
            hit = node.get(None) if node else None
            if hit:
                single |= i == j - 1
                if best[i] + hit[1] > best[j]:
                    best[j], back[j] = best[i] + hit[1], (i, [hit[0]])
        if not single and best[j - 1] + v.penalty > best[j]:
            best[j], back[j] = best[j - 1] + v.penalty, (j - 1, v.characters(t[j - 1]))
    out, j = [], len(t)
    while j:
        i, ids = back[j]
        out, j = ids + out, i
    return out


def test_streaming_is_the_best_path(model):
    e, rnd = pieces.Encoder(model, table_size=50), random.Random(1)
    for _ in range(600):
        t = "".join(rnd.choice("abcdeghilnorst théêñß😀\n\t  漢") for _ in range(rnd.randint(1, 70)))
        want = brute(e.vocabulary, t)
        assert e.encode(t).tolist() == want
        assert list(e.vocabulary.viterbi(SPACE + t.replace(" ", SPACE))) == want
        assert e.decode(want) == t == "".join(e.decode_stream(want))


def test_window_is_bounded_and_streams(model):
    v = pieces.Pieces(model)
    ids = v.viterbi(c for _ in range(30_000) for c in "thera")
    assert next(ids) is not None  # an id before the stream ends
    assert sum(1 for _ in ids) > 1000


def test_rows(spark, model):
    texts = [None, "", " ", "  a  b ", "x" * 50_000, "naïve café\n\n", "a▁b", "\x00�"]
    df = spark.createDataFrame([*enumerate(texts), (0, None), (None, "a")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_ids")
    out = pieces.encoded(df, model)
    got = {(r.doc_id, r.n_ids): r for r in out.collect()}
    assert out.count() == 10
    for i, t in enumerate(texts):
        r = next(x for (k, _), x in got.items() if k == i)
        assert r.n_ids == len(r.ids) and r.round_trip == ("▁" not in (t or "")), t
    back = {r.doc_id: r.text for r in pieces.decoded(out.where("doc_id is not null"), model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    assert pieces.encoded(df.limit(0), model).collect() == []
