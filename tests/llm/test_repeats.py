import random

import pytest

from llm import repeats
from llm.repeats import Params


def brute(texts, least):
    """All maximal repeats: {(words): {(doc, start)}}."""
    at = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
    found = {}
    for x, (d, i) in enumerate(at):
        for e, j in at[x + 1 :]:
            if i and j and texts[d][i - 1] == texts[e][j - 1]:
                continue
            n = 0
            while i + n < len(texts[d]) and j + n < len(texts[e]) and texts[d][i + n] == texts[e][j + n]:
                n += 1
            if n >= least:
                found.setdefault(tuple(texts[d][i : i + n]), set()).update([(d, i), (e, j)])
    for words, places in found.items():
        places |= {(d, i) for d, i in at if tuple(texts[d][i : i + len(words)]) == words}
    return found


def listed(df, texts):
    out, repeats_of = {}, {}
    for r in df.collect():
        repeats_of.setdefault(r["repeat"], []).append(r)
    for rows in repeats_of.values():
        assert {x["rank"] for x in rows} == set(range(max(x["rank"] for x in rows) + 1))
        for r in rows:
            for g in r["groups"] or ():
                places = [(x["doc_id"], x["start"]) for x in rows if r["rank"] <= x["rank"] <= g["last"]]
                d, i = places[0]
                words = tuple(texts[d][i : i + g["n_words"]])
                assert words not in out and len(set(places)) == len(places) and g["n_words"] >= r["n_words"]
                out[words] = set(places)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_brute_force(make, seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefgh"[: rng.choice([2, 8])]) for _ in range(rng.randrange(60))] for _ in range(8)]
    shared = [rng.choice("xyz") for _ in range(15)]
    for t in texts[:5]:
        k = rng.randrange(len(t) + 1)
        t[k:k] = shared[: rng.randrange(8, 16)]
    texts += [list(texts[0]), list(texts[1]), list(texts[0]), list(texts[0]), list(texts[5]), list(texts[5])]
    df = repeats.find_repeats(make([" ".join(t) for t in texts]), Params(min_words=6))
    assert listed(df, texts) == brute(texts, 6)


def test_period_and_blocks_of_words(make, monkeypatch):
    texts = [["a"] * 40, ["a", "b"] * 15, list("abcabcabcabcabc")]
    want = brute(texts, 6)
    df = make([" ".join(t) for t in texts])
    assert listed(repeats.find_repeats(df, Params(6)), texts) == want
    column = [repeats.np.array([ord(c) for c in t], ">u4") for t in texts]
    first = repeats.np.array([0, 3, 5, 0, 2, 1])
    text = repeats.np.array([0, 0, 0, 1, 1, 2])
    end = repeats.np.array([40, 40, 40, 30, 30, 12])
    plain = repeats.suffix_order(column, text, first, end)
    monkeypatch.setattr(repeats, "SORT_BYTES", 0)
    blocks = repeats.suffix_order(column, text, first, end)
    assert [x.tolist() for x in plain] == [x.tolist() for x in blocks]
    rows = repeats.find_repeats(make(["word " * 3000]), Params(50)).collect()
    assert sum(len(r["groups"] or ()) for r in rows) == 3000 - 50


def test_odd_rows(make, spark):
    long = " ".join(f"w{i}" for i in range(3000))
    df = make([None, "", "a b c", long, "x " + long, long], [(None, long, None, None, None), (3, long, None, None, None)])
    df = df.selectExpr("*", "1 AS anchor", "2 AS row", "3 AS __row")
    rows = repeats.find_repeats(df).collect()
    assert len({r["repeat"] for r in rows}) == 1 and {r["n_words"] for r in rows} == {3000}
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"]) for r in rows) == [(-1, 0), (3, 0), (3, 0), (4, 1), (5, 0)]
    assert repeats.find_repeats(df.limit(0)).count() == 0


def test_many_copies_are_sorted_as_two(make):
    text = " ".join(f"w{i}" for i in range(80))
    near = text.replace("w79", "other")
    df = make([text] * 40 + [near] * 3)
    rows = repeats.find_repeats(df).collect()
    assert max(r["rank"] for r in rows) == 3 and sorted(r["doc_id"] for r in rows) == list(range(43))
    groups = sorted(g["n_words"] for r in rows for g in r["groups"] or ())
    assert groups == [79, 80, 80]
