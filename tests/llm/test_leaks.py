import random

import numpy as np
import pytest

from tidemark.llm.leaks import Index, find_leaks, near_prefixes, words


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_words():
    assert words("It's a_b  ÄPFEL-3 x²\n") == ["it", "s", "a", "b", "äpfel", "3", "x²"]
    assert words(None) == words("") == []


def test_edit_distance_against_brute_force():
    draw = random.Random(1)
    for most in (1, 2, 3):
        a = np.array([[draw.randint(0, 4) for _ in range(7)] for _ in range(300)])
        b = np.array([[draw.randint(0, 4) for _ in range(7 + most)] for _ in range(300)])
        for k in range(0, 300, 2):
            b[k, :7] = a[k]
            b[k, draw.randint(0, 6)] = 5
        want = [min(levenshtein([v or -1 for v in x], list(y[:n])) for n in range(8 + most)) for x, y in zip(a.tolist(), b.tolist())]
        assert near_prefixes(a, b, most).tolist() == [min(v, most + 1) for v in want]


def make(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([5, 13, 30])))) for k in range(25)]
    documents = []
    for k in range(80):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(0, 300))]
        if k % 2:
            w = words(draw.choice(items)[1])
            n = draw.choice([12, 13, 20])
            at = draw.randint(0, max(0, len(w) - n))
            spot = draw.randint(0, len(body))
            body[spot:spot] = w[at : at + n]
        documents.append((k, draw.choice([" ", "  \n", " , ", "_"]).join(x.upper() if draw.random() < 0.2 else x for x in body)))
    return items, documents + [(80, None), (81, ""), (82, documents[1][1] + " x" * 50_000)] + documents[:3]


def grams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_exact_windows_are_all_found(spark):
    items, documents = make(1)
    d = spark.createDataFrame(documents, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as edits")
    i = spark.createDataFrame(items + items[:2] + [(99, None)], "item_id bigint, text string")
    want = {(a, b) for a, t in documents for b, u in items if grams(t, 13) & grams(u, 13)}
    for block in (200_000, 150):
        got = [(r.doc_id, r.item_id) for r in find_leaks(d, i, block_words=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_near_windows_reach_the_target_recall():
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(40))) for k in range(60)]
    index = Index(items, 13, 2, 0.95)
    hit = 0
    for k, text in items:
        w = words(text)[10:23]
        w[draw.randint(2, 10)] = "other"
        w[draw.randint(2, 10)] = draw.choice(vocabulary)
        ids = np.array([0] * 13 + [index.vocabulary.get(x, 0) for x in w] + [0] * 13)
        found = index.search(ids, np.zeros(len(ids), np.int64))
        assert (found[2] <= 2).all()
        hit += k in found[1]
    assert hit / len(items) >= 0.9


def test_added_and_lost_words_reach_the_target_recall(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(13))) for k in range(300)]
    for kind in ("changed", "added", "lost"):
        documents = []
        for k, text in items:
            w = words(text)
            at = draw.randint(2, 10)
            w[at : at + (kind != "added")] = [] if kind == "lost" else ["other"]
            documents.append((k, " ".join(["x"] * (k % 3) + w + ["y"] * (k % 2 * 20))))
        found = find_leaks(
            spark.createDataFrame(documents, "doc_id bigint, text string").coalesce(1),
            spark.createDataFrame(items, "item_id bigint, text string"), max_edits=1
        ).collect()
        assert all(r.doc_id == r.item_id and r.edits == 1 for r in found)
        assert len(found) / len(items) >= 0.93, kind


def test_a_passage_belongs_to_the_document_it_starts_in(spark):
    item = " ".join(f"w{k}" for k in range(13))
    documents = [(1, "before"), (2, item.removeprefix("w0 ")), (3, "behind")]
    found = find_leaks(
        spark.createDataFrame(documents, "doc_id bigint, text string").coalesce(1),
        spark.createDataFrame([(1, item)], "item_id bigint, text string"), max_edits=1
    ).collect()
    assert {r.doc_id for r in found} <= {2}


def test_as_many_repetitions_as_the_target_needs(monkeypatch):
    draw = random.Random(6)
    items = [(k, " ".join(f"w{draw.randint(0, 300)}" for _ in range(40))) for k in range(60)]
    some, more, most = (Index(items, 13, 5, target) for target in (0.9, 0.99, 0.997))
    assert some.embedding.repetitions < more.embedding.repetitions < most.embedding.repetitions
    assert most.embedding.repetitions > 128 and most.recall >= 0.997
    monkeypatch.setattr(Index, "MOST", 16)
    with pytest.raises(ValueError):
        Index(items, 13, 5, 0.997)


def test_near_windows_against_all_pairs():
    """Every window of every document against every item window, by edit distance."""
    draw = random.Random(7)
    items = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([9, 14])))) for k in range(12)]
    index = Index(items, 8, 1, 0.9999)
    want, got = set(), set()
    for d in range(90):
        body = [draw.choice("abcdefghxyz") for _ in range(20)]
        k, text = draw.choice(items)
        body[5:5] = words(text)
        at = draw.randint(5, 12)
        body[at : at + draw.randint(0, 1)] = draw.choice([[], ["x"], ["a"]])
        ids = np.array([index.vocabulary.get(x, 0) for x in body] + [0] * 8)
        found = index.search(ids, np.where(np.arange(len(ids)) < len(body), d, -1))
        got |= set(zip(found[0].tolist(), found[1].tolist()))
        coded = [index.vocabulary.get(x, -1) for x in body]
        want |= {
            (d, int(o)) for w, f,
            t in zip(
                index.windows.tolist(), index.owners_from, index.owners_from[1:]
            ) for o in index.owner[f:t] for s in range(len(coded) - 7) for n in (7, 8, 9) if levenshtein(w, coded[s : s + n]) <= 1
        }
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60
